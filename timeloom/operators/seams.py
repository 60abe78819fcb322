"""Joins between ranges and events in a signal: junctions refined on both sides, events kept apart, steady windows, best steps, phrase measures and fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import settled


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, also where it is named inside functions of an array's elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sides(rows: DataFrame, levels: DataFrame, centre: str, low: Column, high: Column, name: str) -> DataFrame:
    """(rec, ord, name, name_level, name_moved): frames from ``low`` up to but without ``high``; the nearest frame to the centre where there is none."""
    lone = F.array(F.greatest(F.lit(0), F.least(F.col(centre), F.col("frames") - 1)))
    grid = rows.select("rec", "ord", centre, F.explode(F.when(high > low, F.sequence(low, high - 1)).otherwise(lone)).alias("k"), (high > low).alias("free"))
    moved = F.when(F.col("free"), F.abs(F.col("k") - F.col(centre))).otherwise(0)
    return grid.join(levels, ["rec", "k"]).select("rec", "ord", F.col("k").alias(name), F.col("level").alias(f"{name}_level"), moved.alias(f"{name}_moved"))


def _choices(rows: DataFrame, levels: DataFrame, reach: int, per_frame: int, floor: int, apart: int) -> DataFrame:
    """(rec, ord, leave, enter, kept) of junctions (rec, ord, a, b, next_a, next_b, frames)."""
    room = lambda a, b: F.floor((F.col(b) - F.col(a)) * 4 / 10)
    last = F.col("frames") - 1
    outs = _sides(rows, levels, "b", F.greatest(F.lit(0), F.col("b") - reach, F.col("b") - room("a", "b")), F.least(last, F.col("b") + reach), "leave")
    ins = _sides(rows, levels, "next_a", F.greatest(F.lit(0), F.col("next_a") - reach), F.least(last, F.col("next_a") + reach, F.col("next_a") + room("next_a", "next_b")), "enter")
    pairs = outs.join(ins, ["rec", "ord"]).where("enter > leave")
    mismatch = F.abs(F.col("leave_level") - F.col("enter_level"))
    cost = 4 * mismatch + F.col("leave_level") + F.col("enter_level") + 4 * per_frame * (F.col("leave_moved") + F.col("enter_moved"))
    best = pairs.groupBy("rec", "ord").agg(F.min(F.struct(cost.alias("cost"), "leave", "enter", F.greatest("leave_level", "enter_level").alias("loudest"), mismatch.alias("mismatch"))).alias("best"))
    fine = (F.col("best.loudest") <= floor) & (F.col("best.mismatch") <= apart)
    return rows.select("rec", "ord").join(best, ["rec", "ord"], "left").select("rec", "ord", "best.leave", "best.enter", F.coalesce(fine, F.lit(False)).alias("kept"))


def junctions(levels: DataFrame, ranges: DataFrame, reach: int, per_frame: int = 4, floor: int = -3400, apart: int = 900) -> DataFrame:
    """(rec, ord, leave, enter, kept): for each range (rec, ord, a, b) that another follows, the frames at which to leave it and to enter the next.

    Levels (rec, k, level) and limits are in hundredths of a decibel. Of all pairs within ``reach`` frames of both edges, the one of the
    least mismatch, half mean level and ``per_frame`` for each frame moved is chosen, of equal ones the first; neither side may lose more
    than 40 % of its range. A junction whose louder side is above ``floor`` or whose sides are more than ``apart`` is not kept.
    Candidates are a bounded grid of offsets joined to frames by an equi key. What a junction moves is the next range's
    beginning, and with it the room on that range's other side: junctions whose range begins elsewhere than assumed are
    decided again until none does.
    """
    frames = levels.groupBy("rec").agg((F.max("k") + 1).alias("frames"))
    order = Window.partitionBy("rec").orderBy("ord")
    rows = ranges.select("rec", "ord", "a", "b", F.lead("a").over(order).alias("next_a"), F.lead("b").over(order).alias("next_b"), F.row_number().over(order).alias("nth")).where("next_a IS NOT NULL").join(frames, "rec")
    rows = settled(rows)
    done = settled(_choices(rows, levels, reach, per_frame, floor, apart))
    begins = rows.select("rec", "ord", "nth", F.col("a").alias("first_a"))
    known = rows.select("rec", "ord", F.col("a").alias("assumed"))
    while True:
        numbered = done.join(begins, ["rec", "ord"])
        before = numbered.select("rec", (F.col("nth") + 1).alias("nth"), "enter", "kept")
        now = numbered.select("rec", "ord", "nth", "first_a").join(before, ["rec", "nth"], "left").select("rec", "ord", F.when(F.col("kept"), F.col("enter")).otherwise(F.col("first_a")).alias("a"))
        open_ = settled(now.join(known, ["rec", "ord"]).where("a <> assumed").select("rec", "ord", "a"))
        if open_.isEmpty():
            return done
        again = _choices(rows.drop("a").join(open_, ["rec", "ord"]), levels, reach, per_frame, floor, apart)
        done = settled(done.join(open_, ["rec", "ord"], "left_anti").unionByName(again))
        known = settled(known.join(open_, ["rec", "ord"], "left_anti").unionByName(open_.select("rec", "ord", F.col("a").alias("assumed"))))


def refined(ranges: DataFrame, chosen: DataFrame, least: int = 0) -> DataFrame:
    """(rec, a, b): ranges with their kept junctions' edges; over a junction that is not kept two ranges are one again, with what lay between. Ranges of ``least`` or fewer frames go."""
    order = Window.partitionBy("rec").orderBy("ord")
    rows = ranges.join(chosen, ["rec", "ord"], "left")
    kept, into = F.lag(F.coalesce("kept", F.lit(False))).over(order), F.lag("enter").over(order)
    fresh = F.coalesce(kept, F.lit(True))
    rows = rows.withColumn("fresh", fresh).withColumn("start", F.when(kept, into).otherwise(F.col("a")))
    rows = rows.withColumn("run", F.sum(F.col("fresh").cast("int")).over(order)).withColumn("end", F.when(F.col("kept"), F.col("leave")).otherwise(F.col("b")))
    whole = rows.groupBy("rec", "run").agg(F.min_by("start", "ord").alias("a"), F.max_by("end", "ord").alias("b"))
    before = F.lag("b").over(Window.partitionBy("rec").orderBy("run"))
    return whole.select("rec", F.greatest("a", before).alias("a"), "b").where(F.col("b") - F.col("a") > least)


def spaced(events: DataFrame, apart: int = 5) -> DataFrame:
    """Of events (rec, k) from the first of a recording on each next one that lies more than ``apart`` behind the last one kept.

    Each event points to the next one it allows. An event more than ``apart`` behind the one before it is kept in any
    case, so pointers are followed from all of those at once, by doubling: rounds grow with the logarithm of the longest run.
    """
    order = Window.partitionBy("rec").orderBy("k")
    ahead = F.least(*[F.when(F.lead("k", n).over(order) - F.col("k") > apart, F.lead("k", n).over(order)) for n in range(1, apart + 2)])
    rows = settled(events.select("rec", "k").distinct().select("rec", "k", ahead.alias("to"), F.coalesce(F.col("k") - F.lag("k").over(order) > apart, F.lit(True)).alias("head")))
    kept, jumps = rows.where("head").select("rec", "k"), rows.where("to IS NOT NULL").select("rec", "k", "to")
    many = -1
    while (now := kept.count()) != many:
        many = now
        kept = settled(kept.unionByName(kept.join(jumps, ["rec", "k"]).select("rec", F.col("to").alias("k"))).distinct())
        jumps = settled(jumps.alias("x").join(jumps.alias("y"), (F.col("x.rec") == F.col("y.rec")) & (F.col("x.to") == F.col("y.k"))).select("x.rec", "x.k", "y.to"))
    return kept


def clicks(frames: DataFrame, radius: int = 30, factor: int = 5, quiet: float = 0.0316, apart: int = 5) -> DataFrame:
    """(rec, k): steps of the signal (rec, k, v) above ``factor`` times the median step around them, where the median magnitude is below
    ``quiet`` of the recording's largest; a click keeps out those within ``apart`` frames behind it. Frames without ``radius`` frames on both sides have none."""
    order = Window.partitionBy("rec").orderBy("k")
    near = order.rowsBetween(-radius, radius - 1)
    rows = frames.select("rec", "k", F.abs("v").alias("level"), F.coalesce(F.abs(F.col("v") - F.lag("v").over(order)), F.lit(0)).alias("step"))
    top = rows.groupBy("rec").agg(F.max("level").alias("top"), F.max("k").alias("last"))
    rows = rows.select("rec", "k", "step", F.percentile("step", F.lit(0.5)).over(near).alias("around"), F.percentile("level", F.lit(0.5)).over(near).alias("context")).join(top, "rec")
    loud = (F.col("step") > factor * F.col("around")) & (F.col("context") < quiet * F.col("top"))
    return spaced(rows.where(loud & (F.col("k") >= radius) & (F.col("k") <= F.col("last") - radius)).select("rec", "k"), apart)


def best_step(profile: Column, margin: int = 8) -> Column:
    """(at, gap): where a row profile's head and tail differ most in their means, ``margin`` rows from either end at least; of equal ones the first.

    One pass over the array with a running sum. Null where no split is possible.
    """

    def split(values: Column) -> Column:
        return _once(F.struct(F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x).alias("all"), F.size(values).alias("n")), lambda t: walk(values, t))

    def walk(values: Column, t: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"), F.lit(-1.0).alias("gap"), F.lit(None).cast("int").alias("at"))

        def step(s: Column, x: Column) -> Column:
            gap = F.abs(s["sum"] / s["i"] - (t["all"] - s["sum"]) / (t["n"] - s["i"]))
            better = (s["i"] >= margin) & (s["i"] < t["n"] - margin) & (gap > s["gap"])
            return F.struct((s["i"] + 1).alias("i"), (s["sum"] + x).alias("sum"), F.when(better, gap).otherwise(s["gap"]).alias("gap"), F.when(better, s["i"]).otherwise(s["at"]).alias("at"))

        return F.aggregate(values, start, step, lambda s: F.when(s["at"].isNotNull(), F.struct(s["at"].alias("at"), s["gap"].alias("gap"))))

    return _once(profile, split)


def row_steps(pictures: DataFrame, moving: int = 30, step: float = 1.35) -> DataFrame:
    """(rec, ord, at, gap, torn): how each picture (rec, ord, rows) differs from the one before it, row by row, and where that changes most.

    A picture is torn if some row moved by ``moving`` or more and the step exceeds ``step`` mean differences, one half at least. A recording's first picture has no row here.
    """
    before = F.lag("rows").over(Window.partitionBy("rec").orderBy("ord"))
    rows = pictures.withColumn("before", before).where("before IS NOT NULL").select("rec", "ord", F.zip_with("rows", "before", lambda x, y: F.abs(x - y)).alias("profile"))
    mean = F.aggregate("profile", F.lit(0).cast("long"), lambda s, x: s + x) / F.size("profile")
    rows = rows.select("rec", "ord", best_step(F.col("profile")).alias("best"), F.array_max("profile").alias("most"), mean.alias("mean"))
    torn = (F.col("most") >= moving) & (F.col("best.gap") / F.greatest("mean", F.lit(0.5)) > step)
    return rows.where("best IS NOT NULL").select("rec", "ord", F.col("best.at").alias("at"), F.col("best.gap").alias("gap"), torn.alias("torn"))


def steady_windows(frames: DataFrame, part: int, wide: int, hop: int, swing: float = 2.2, crest: float = 4.0, silent: float = 0.0008, least: float = 2.0) -> DataFrame:
    """(rec, start, energy): windows of ``wide`` parts of ``part`` frames each, every ``hop`` parts, that are neither silence nor an event.

    A window is silence if its level is not above ``silent`` of the recording's, ``least`` at any rate. It is steady if its loudest part
    is at most ``swing`` times its quietest, which is not zero, and its peak at most ``crest`` times its level. Parts are summed first; a part
    belongs to ``wide / hop`` windows. Frames that fill no part or window count only for the recording's level.
    """
    parts = frames.groupBy("rec", F.floor(F.col("k") / part).alias("at")).agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.max(F.abs("v")).alias("peak"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("rec").agg(F.sum("energy").alias("all"), F.sum("n").alias("frames"))
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("at") - wide + 1) / hop)), F.floor(F.col("at") / hop))
    held = parts.where(F.col("n") == part).select("rec", "energy", "peak", F.explode(starts).alias("q"))
    rows = held.groupBy("rec", "q").agg(F.sum("energy").alias("energy"), F.min("energy").alias("low"), F.max("energy").alias("high"), F.max("peak").alias("peak"), F.count(F.lit(1)).alias("n")).where(F.col("n") == wide)
    rows = rows.join(whole, "rec")
    size = part * wide
    heard = F.col("energy") > F.greatest(F.lit(least * least * size), silent * silent * size * F.col("all") / F.col("frames"))
    steady = (F.col("low") > 0) & (F.col("high") <= swing * swing * F.col("low")) & (F.col("peak") * F.col("peak") * size <= crest * crest * F.col("energy"))
    return rows.where(heard & steady).select("rec", (F.col("q") * hop * part).alias("start"), "energy")


def room_tone(windows: DataFrame, share: float = 0.1) -> DataFrame:
    """(rec, start, energy): the steady window at index floor(n * share) by energy, then start."""
    rows = windows.withColumn("nth", F.row_number().over(Window.partitionBy("rec").orderBy("energy", "start"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rec")))
    return rows.where(F.col("nth") == F.least(F.col("n"), F.floor(F.col("n") * share) + 1)).select("rec", "start", "energy")


def phrase_measures(frames: DataFrame, phrases: DataFrame, tail: int, step_tail: int, step_before: int, bucket: int = 256) -> DataFrame:
    """(rec, id, frames, voiced, median, spread, terminal_slope, sustain, terminal_step) of phrases (rec, id, a, b) over frames (rec, k, pitch, level).

    Frames meet phrases in buckets of places and are measured from each phrase's end: the slope of pitch over the last ``tail`` frames
    before its last voiced one, that of level over its final third, and the median pitch of the last ``step_tail`` frames less that of the
    ``step_before`` before them. A frame without pitch is unvoiced. Phrases of fewer than six frames or five voiced ones have no row; slopes
    need three frames, the step eight voiced ones and three on both sides, else null.
    """
    held = phrases.select("rec", "id", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))).alias("bucket"))
    placed = frames.withColumn("bucket", F.floor(F.col("k") / bucket))
    rows = placed.join(held, ["rec", "bucket"]).where("k BETWEEN a AND b")
    rows = rows.withColumn("last", F.max(F.when(F.col("pitch").isNotNull(), F.col("k"))).over(Window.partitionBy("rec", "id")))
    voiced, k = F.col("pitch").isNotNull(), F.col("k")
    late, third = voiced & (k >= F.col("last") - tail), 3 * k >= 3 * F.col("a") + 2 * (F.col("b") - F.col("a"))
    ending, leading = voiced & (k >= F.col("last") - step_tail), voiced & (k < F.col("last") - step_tail) & (k >= F.col("last") - step_tail - step_before)

    def slope(value: str, some: Column) -> Column:
        """Least squares from sums, which are exact for whole numbers."""
        both = some & F.col(value).isNotNull()
        n, total = F.count_if(both), lambda x: F.sum(F.when(both, x))
        x, y, xx, xy = total(k), total(F.col(value)), total(k * k), total(k * F.col(value))
        return F.when(n >= 3, (n * xy - x * y) / F.nullif(n * xx - x * x, F.lit(0)))

    median = lambda some: F.percentile(F.when(some, F.col("pitch")), F.lit(0.5))
    enough = (F.count_if(voiced) >= 8) & (F.count_if(ending) >= 3) & (F.count_if(leading) >= 3)
    found = rows.groupBy("rec", "id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(voiced).alias("voiced"),
        F.percentile("pitch", F.lit(0.5)).alias("median"),
        (F.percentile("pitch", F.lit(0.75)) - F.percentile("pitch", F.lit(0.25))).alias("spread"),
        slope("pitch", late).alias("terminal_slope"),
        slope("level", third).alias("sustain"),
        F.when(enough, median(ending) - median(leading)).alias("terminal_step"),
    )
    return found.where("frames >= 6 AND voiced >= 5")


def fingerprint(rows: DataFrame, key: list[str], order: str, columns: list[str], width: int = 1000) -> DataFrame:
    """(key, n, fingerprint): a digest of the rows of each key that depends on their order and every column, equal however they are dealt out.

    Rows are numbered by ``order`` from 0, each number once. Digests of ``width`` numbers make one digest, as many of these another,
    and what is left the last; so a task gathers ``width`` digests at a time, and for the last as many as there are squares of it. Nulls differ from all texts.
    """
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    level = rows.select(*key, F.col(order).cast("long").alias("at"), F.lit(1).cast("long").alias("n"), F.sha2(F.concat_ws("\x1f", *map(cell, columns)), 256).alias("digest"))
    for last in (False, False, True):
        group = [*key] if last else [*key, "bucket"]
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda d: F.concat(d["at"].cast("string"), F.lit(":"), d["digest"])), ","), 256)
        level = level.withColumn("bucket", F.floor(F.col("at") / width)).groupBy(*group).agg(F.sum("n").alias("n"), joined.alias("digest"))
        level = level if last else level.withColumnRenamed("bucket", "at")
    return level.withColumnRenamed("digest", "fingerprint")
