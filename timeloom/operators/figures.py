"""Figures and filters over takes, clips and frame tables: floors, tails, pauses, summaries, curves and columns of a strip.

Frame tables are (rec, k, v), energies (rec, win, energy). Whole numbers stand for times (ms) and levels, so that results do not
depend on the order of rows. Nulls in a measured column are left out of that measure; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as t

from .frames import pct_index


def local_floor(frames: DataFrame, spans: DataFrame, look: int, percentile: float = 0.3) -> DataFrame:
    """(rec, id, floor) of spans (rec, id, first, last): the level around a span, within ``look`` frames on both sides.

    Of these frames' sizes those up to half the largest count (the least one if there are none), and of them the one at the
    index of ``percentile``. Spans and frames meet by (rec, k); a span asks for 2 * look frames at most.
    """
    before = F.when(F.col("first") > 0, F.sequence(F.greatest(F.lit(0), F.col("first") - look), F.col("first") - 1))
    near = F.concat(F.coalesce(before, F.array().cast("array<bigint>")), F.sequence(F.col("last") + 1, F.col("last") + look))
    asked = spans.select("rec", "id", F.explode(near).alias("k"))
    sizes = asked.join(frames.select("rec", "k", F.abs("v").alias("size")), ["rec", "k"]).groupBy("rec", "id").agg(F.collect_list("size").alias("sizes"))
    quiet = F.filter("sizes", lambda x: 2 * x <= F.array_max("sizes"))
    return sizes.select("rec", "id", F.when(F.size(quiet) > 0, pct_index(quiet, percentile)).otherwise(F.array_min("sizes")).alias("floor"))


def tail_levels(levels: DataFrame, tail: int, least: int = 10, share: float = 0.7) -> DataFrame:
    """(rec, body, tail): the ``share`` percentile of all windows' energies and the median of the last ``tail``; no row below ``least`` windows."""
    place = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("win")))
    rows = levels.withColumn("late", F.when(place <= tail, F.col("energy")))
    found = rows.groupBy("rec").agg(F.count("energy").alias("n"), F.percentile("energy", F.lit(share)).alias("body"), F.percentile("late", F.lit(0.5)).alias("tail"))
    return found.where(F.col("n") >= least).select("rec", "body", "tail")


def pause_levels(levels: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """(rec, worst): the loudest median energy of a quiet run (rec, first, last) of ``least`` windows or more.

    Windows meet runs by (rec, win).
    """
    asked = runs.where(F.col("last") - F.col("first") + 1 >= least).select("rec", F.col("first").alias("run"), F.explode(F.sequence("first", "last")).alias("win"))
    medians = asked.join(levels, ["rec", "win"]).groupBy("rec", "run").agg(F.percentile("energy", F.lit(0.5)).alias("median"))
    return medians.groupBy("rec").agg(F.max("median").alias("worst"))


def quietest_near(levels: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """(rec, id, win, energy): of each point (rec, id, at) the window of least energy within ``reach``, the first of equals."""
    asked = points.select("rec", "id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - reach), F.col("at") + reach)).alias("win"))
    best = F.min(F.struct("energy", "win")).alias("best")
    return asked.join(levels, ["rec", "win"]).groupBy("rec", "id").agg(best).select("rec", "id", "best.win", "best.energy")


def donors(clips: DataFrame) -> DataFrame:
    """Clips (rec, id, level) between half and twice their recording's upper median level; of two or fewer all."""
    whole = Window.partitionBy("rec")
    rows = clips.withColumn("nth", F.row_number().over(whole.orderBy("level", "id"))).withColumn("n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("middle", F.max(F.when(F.col("nth") == F.floor(F.col("n") / 2) + 1, F.col("level"))).over(whole))
    near = (2 * F.col("level") >= F.col("middle")) & (F.col("level") <= 2 * F.col("middle"))
    return rows.where((F.col("n") <= 2) | (F.col("middle") <= 0) | near).select("rec", "id", "level", "middle")


def summary(phrases: DataFrame, key: str, rising: float) -> DataFrame:
    """By ``key`` of phrases (text, slope, spread): how many, how many statements, medians of the spread and of the slopes of statements and others, and the percentage of statements that rise."""
    ends = t.statement_end(F.col("text")) & F.col("slope").isNotNull()
    others = ~t.statement_end(F.col("text")) & F.col("slope").isNotNull()
    n = F.count_if(ends)
    return phrases.groupBy(key).agg(
        F.count(F.lit(1)).alias("phrases"), n.alias("statements"), F.percentile("spread", F.lit(0.5)).alias("median_spread"),
        F.percentile(F.when(ends, F.col("slope")), F.lit(0.5)).alias("statement_slope"), F.percentile(F.when(others, F.col("slope")), F.lit(0.5)).alias("other_slope"),
        F.round(100 * F.count_if(ends & (F.col("slope") > rising)) / F.greatest(F.lit(1), n), 3).alias("rising_percent"),
    )


def chosen_summary(clips: DataFrame, key: str) -> DataFrame:
    """By ``key`` of clips (source, ms, pace, clicks): count, length, means, and the distinct sources in order."""
    return clips.groupBy(key).agg(F.count(F.lit(1)).alias("clips"), F.sum("ms").alias("ms"), F.round(F.avg("pace"), 3).alias("pace"), F.round(F.avg("clicks"), 3).alias("clicks"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def usable(clips: DataFrame, most_clicks: int, pace: int, within: int, least_ms: int) -> DataFrame:
    """Clips (clicks, pace, ms) with few clicks, a pace near the one wanted, and long enough."""
    return clips.where((F.col("clicks") <= most_clicks) & (F.abs(F.col("pace") - pace) <= within) & (F.col("ms") >= least_ms))


def first_readings(found: DataFrame, least: float = 0.65, shortest: int = 1200, longest: int = 16_000, pad: int = 0) -> DataFrame:
    """Of readings (rec, unit, a, b, matched, wanted, stumbled) one of each unit: the first that matches enough words, does not stumble and fits in length."""
    length = F.col("b") + pad - F.greatest(F.lit(0), F.col("a") - pad)
    fine = (F.col("wanted") > 0) & (F.col("matched") >= least * F.col("wanted")) & ~F.col("stumbled") & length.between(shortest, longest)
    nth = F.row_number().over(Window.partitionBy("unit").orderBy("rec", "a", "b"))
    return found.where(fine).withColumn("nth", nth).where("nth = 1").drop("nth")


def session_report(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(rec, kept, stumbled, heard): of each session's readings (rec, matched, stumbled) how many were kept (rec, unit), stumbled, and the words heard."""
    all_of = found.groupBy("rec").agg(F.count_if("stumbled").alias("stumbled"), F.sum("matched").alias("heard"))
    return all_of.join(kept.groupBy("rec").agg(F.count(F.lit(1)).alias("kept")), "rec", "left").select("rec", F.coalesce("kept", F.lit(0)).alias("kept"), "stumbled", "heard")


def clicks_per_minute(clicks: Column, ms: Column) -> Column:
    """Null without a length."""
    return F.when(ms > 0, F.round(clicks * 60_000 / ms, 3))


def strip(peaks: DataFrame, buckets: int, view: tuple[int, int], pixels: int) -> DataFrame:
    """(rec, x, peak): the largest of the buckets (rec, bucket, peak) that each pixel of a view (from, to, in thousandths of the whole) covers.

    A bucket goes to the pixels it overlaps, so the join is an explode: each pixel covers from
    floor(its start) up to ceil(its end), one bucket at least.
    """
    low, span = view[0], view[1] - view[0]
    unit = pixels * 1000
    x = F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))).alias("x")
    edges = peaks.select("rec").distinct().select("rec", x)
    first = F.floor((low * pixels + F.col("x") * span) * F.lit(buckets) / unit)
    last = F.greatest(first + 1, F.least(F.lit(buckets), F.ceil((low * pixels + (F.col("x") + 1) * span) * F.lit(buckets) / unit))) - 1
    cells = edges.select("rec", F.col("x").cast("long").alias("x"), F.explode(F.sequence(first, last)).alias("bucket"))
    return cells.join(peaks, ["rec", "bucket"]).groupBy("rec", "x").agg(F.max("peak").alias("peak"))


def curve(points: DataFrame, n: int = 24) -> DataFrame:
    """(rec, i, v): curves (rec, at, v) at ``n`` times evenly from first to last, straight between neighbours; a curve of one point has none.

    A piece between two points gives the grid times that fall into it, so no curve is gathered.
    """
    order, whole = Window.partitionBy("rec").orderBy("at", "v"), Window.partitionBy("rec")
    rows = points.withColumn("to", F.lead("at").over(order)).withColumn("v_to", F.lead("v").over(order))
    rows = rows.withColumn("low", F.min("at").over(whole)).withColumn("high", F.max("at").over(whole)).where("high > low AND (to IS NULL OR to > at)")
    step = (F.col("high") - F.col("low")) / (n - 1)
    first = F.ceil((F.col("at") - F.col("low")) / step)
    # the end of a piece belongs to the next one, but for the last
    last = F.when(F.col("to").isNull(), F.lit(n - 1)).otherwise(F.ceil((F.col("to") - F.col("low")) / step) - 1)
    grid = rows.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("i"))
    share = (F.col("low") + F.col("i") * step - F.col("at")) / (F.col("to") - F.col("at"))
    return grid.select("rec", "i", (F.col("v") + F.coalesce(share * (F.col("v_to") - F.col("v")), F.lit(0.0))).alias("v"))


def corrected(texts: DataFrame, fixes: DataFrame) -> DataFrame:
    """(rec, id, text, applied): texts with the fixes (rec, id, nth, wrong, right) made in their order, each at the first whole word that it finds.

    A fix sees the text that those before it left; ``applied`` counts those that found their word.
    """
    listed = fixes.where("wrong <> ''").groupBy("rec", "id").agg(F.array_sort(F.collect_list(F.struct("nth", "wrong", "right"))).alias("fixes"))
    state = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("applied"))

    def fix(s: Column, f: Column) -> Column:
        # a word is what no letter, digit or underscore touches; the text is taken apart at its first place
        pattern = F.concat(F.lit(r"(?s)^(.*?)\b\Q"), f["wrong"], F.lit(r"\E\b(.*)$"))
        hit = F.regexp_like(s["text"], pattern)
        part = lambda n: F.call_function("regexp_extract", s["text"], pattern, F.lit(n))
        joined = F.concat(part(1), f["right"], part(2))
        return F.struct(F.when(hit, joined).otherwise(s["text"]).alias("text"), (s["applied"] + hit.cast("long")).alias("applied"))

    done = F.when(F.col("text").isNotNull() & F.col("fixes").isNotNull(), F.aggregate("fixes", state, fix)).otherwise(state)
    return texts.join(listed, ["rec", "id"], "left").withColumn("done", done).select("rec", "id", "done.text", "done.applied")


def torn(frames: DataFrame, motion: float = 2.0, ratio: float = 1.45) -> DataFrame:
    """(rec, frames, torn, percent): frames (rec, motion, step) with enough motion whose step stands out, by recording."""
    bad = (F.col("motion") >= motion) & (F.col("step") > ratio)
    n = F.count(F.lit(1))
    return frames.groupBy("rec").agg(n.alias("frames"), F.count_if(bad).alias("torn"), F.round(100 * F.count_if(bad) / n, 3).alias("percent"))


def timeline_end(durations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rec, end): the duration (rec, duration) or the end of the last block (rec, until), whichever is later."""
    return durations.join(blocks.groupBy("rec").agg(F.max("until").alias("until")), "rec", "left").select("rec", F.greatest("duration", "until").alias("end"))


def examples_of(lines: DataFrame, other_than: int) -> DataFrame:
    """Lines (rec, id, original, say, dropped, locked) of other recordings whose text was changed and that stay: (rec, id, original, say)."""
    fine = (F.col("rec") != other_than) & ~F.col("dropped") & ~F.col("locked") & (t.squash(F.col("say")) != t.squash(F.col("original")))
    return lines.where(fine).select("rec", "id", "original", "say")


def safe_suggestions(suggested: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, after): suggestions (id, kind, before, after) that may be taken together: no drop, the line not edited and still as it was."""
    rows = suggested.where("kind <> 'drop'").join(lines.select("id", "say", "edited"), "id")
    return rows.where(~F.col("edited") & (F.col("say") == F.col("before"))).select("id", "after")
