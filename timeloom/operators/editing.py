"""Edits of numbered script lines: results put back by id, states, extents, context of batches, placement and summaries.

Lines are rows (rec, ord, id, start, end, …) in whole milliseconds. Every join has an id or (rec, ord) as its key; what looks
before or behind is a window over ``rec``. A null id or text matches nothing and leaves a line as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as t


def _by(rec: str, *order: str | Column):
    return Window.partitionBy(rec).orderBy(*order)


def apply_rewrites(lines: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Rewritten text (id, after) put on the lines whose ``say`` is still their ``original``."""
    fresh = (F.col("say") == F.col("original")) & F.col("after").isNotNull()
    rows = lines.join(rewrites.select("id", "after"), "id", "left").withColumn("written", F.coalesce(fresh, F.lit(False)))
    return rows.withColumn("say", F.when(F.col("written"), F.col("after")).otherwise(F.col("say"))).drop("after")


def absorb(lines: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of ``results`` (id, …) where they are known; all other columns, edited text among them, stay."""
    new = results.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    return lines.join(new, "id", "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in lines.columns])


def machine_text(lines: DataFrame, flow: DataFrame, given: DataFrame, refused: DataFrame) -> DataFrame:
    """Adds ``machine_say``, the text that the last machine pass left, and whether ``say`` was edited by hand since.

    The pass's own text stands first, then the line of the ``flow`` pass (rec, ord, text), of a
    refused line (rec, ord) what the pass was ``given``, then the original.
    """
    at = ["rec", "ord"]
    rows = lines.join(flow.select(*at, F.col("text").alias("flow")), at, "left").join(given.select(*at, F.col("text").alias("given")), at, "left")
    rows = rows.join(refused.select(*at, F.lit(True).alias("refused")).distinct(), at, "left")
    flow_text = F.when(F.coalesce("refused", F.lit(False)), F.col("given")).otherwise(F.col("flow"))
    rows = rows.withColumn("machine_say", F.coalesce("machine", flow_text, "original")).drop("flow", "given", "refused")
    return rows.withColumn("by_hand", t.squash(F.col("say")) != t.squash(F.col("machine_say")))


def pinned_notes(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines with the notes (id, against, note) made for the text that they still have; a dropped or locked line has none."""
    live = lines.where(~F.col("dropped") & ~F.col("locked"))
    return live.join(notes, "id").where(t.squash(F.col("against")) == t.squash(F.col("say")))


def batch_context(lines: DataFrame, size: int, near: int = 2) -> DataFrame:
    """(rec, batch, role, ord, id): the lines of each batch of ``size`` and the ``near`` before and after it."""
    own = F.floor(F.col("ord") / size)
    rows = lines.withColumn("last", F.floor(F.max("ord").over(Window.partitionBy("rec")) / size))
    place = F.col("ord") % size
    before = F.when((place >= size - near) & (own < F.col("last")), F.struct((own + 1).alias("batch"), F.lit("before").alias("role")))
    after = F.when((place < near) & (own > 0), F.struct((own - 1).alias("batch"), F.lit("after").alias("role")))
    roles = F.array_compact(F.array(F.struct(own.alias("batch"), F.lit("line").alias("role")), before, after))
    return rows.select("rec", "ord", "id", F.explode(roles).alias("r")).select("rec", "r.batch", "r.role", "ord", "id")


def line_state(dropped: Column, locked: Column, audio: Column, rendered_from: Column, signature: Column) -> Column:
    """What a line needs: a take that was rendered from other settings is stale."""
    fresh = F.coalesce(rendered_from == signature, F.lit(False))
    return F.when(dropped, "dropped").when(locked, "real").when(~audio, "todo").when(~fresh, "stale").otherwise("done")


def check_state(audio: Column, score: Column, ok: Column) -> Column:
    """Suspect if it was checked and is not right, unchecked if there is a take without a score; else null."""
    return F.when(audio & score.isNull(), "unchecked").when(score.isNotNull() & ~F.coalesce(ok, F.lit(False)), "suspect")


def block_span(lines: DataFrame) -> DataFrame:
    """Adds ``from`` and ``until``: where a line's take plays, stretched (thousandths), moved and held, or where the original does."""
    take = F.col("audio") & ~F.col("locked") & ~F.col("dropped")
    length = F.when(take, F.col("len")).otherwise(0)
    placed = F.when(length > 0, F.floor(length * F.col("stretch_milli") / 1000)).otherwise(F.col("end") - F.col("start"))
    begin = F.col("start") + F.when(take, F.col("offset")).otherwise(0)
    return lines.withColumn("from", begin).withColumn("until", begin + placed + F.when(take, F.col("hold")).otherwise(0))


def too_short(words: Column, length: Column, per_minute: int = 260, percent: int = 60) -> Column:
    """Whether a take has less than ``percent`` of the time that its words take at a pace nobody exceeds; false without words."""
    return (words > 0) & (length * per_minute * 100 < words * 60_000 * percent)


def after_cuts(totals: DataFrame, cuts: DataFrame) -> DataFrame:
    """(rec, total, left): what remains of ``total`` when the cuts (rec, a, b) are gone; a cut counts up to the end."""
    inside = F.greatest(F.lit(0), F.least("b", "total") - F.col("a"))
    gone = cuts.join(totals, "rec").groupBy("rec").agg(F.sum(inside).alias("gone"))
    return totals.join(gone, "rec", "left").select("rec", "total", (F.col("total") - F.coalesce("gone", F.lit(0))).alias("left"))


def best_verdict(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """One attempt of each key: it said the line, misses no name, is right, then exact (or score), score, and the quieter tail; the first of equals."""
    said = F.coalesce(F.col("ok") | (F.col("why") == "tail"), F.lit(False)).cast("int")
    rank = F.struct(said, (F.coalesce("missing", F.lit(0)) == 0).cast("int"), F.coalesce(F.col("ok"), F.lit(False)).cast("int"), F.coalesce("exact", "score", F.lit(0)), F.coalesce("score", F.lit(0)), -F.coalesce("tail_db", F.lit(0)), -F.col("attempt"))
    return verdicts.groupBy(*key).agg(F.max_by(F.struct("attempt", "score"), rank).alias("best")).select(*key, "best.attempt", "best.score")


def newest(rows: DataFrame, key: list[str], order: list[str], keep: int = 2) -> DataFrame:
    """The ``keep`` newest rows of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_nth") <= keep).drop("_nth")


def clamped_fillers(fillers: DataFrame, sentences: DataFrame, pad: int) -> DataFrame:
    """Fillers (rec, id, a, b) outside all sentences (rec, a, b), padded, but never into a neighbour's speech: (rec, id, lo, hi).

    Windows over both, ordered by time: the last end up to a filler, the first start from its end on,
    and the furthest end of what began before it, which tells whether a sentence holds it.
    """
    both = lambda mine, theirs: fillers.select("rec", "id", "a", "b", F.col(mine).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("edge")).unionByName(sentences.select("rec", F.lit(None).cast("long").alias("id"), "a", "b", F.col(mine).alias("at"), F.lit(0).alias("asks"), F.col(theirs).alias("edge")))
    ends = both("a", "b").where("asks = 1").unionByName(sentences.select("rec", F.lit(None).cast("long").alias("id"), "a", "b", F.col("b").alias("at"), F.lit(0).alias("asks"), F.col("b").alias("edge")))
    before = ends.withColumn("last_end", F.max("edge").over(_by("rec", "at", "asks"))).where("asks = 1").select("rec", "id", "a", "b", "last_end")
    holding = both("a", "b").withColumn("reach", F.max("edge").over(_by("rec", "at", "asks"))).where("asks = 1").select("rec", "id", "reach")
    starts = fillers.select("rec", "id", F.col("b").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("edge")).unionByName(sentences.select("rec", F.lit(None).cast("long").alias("id"), F.col("a").alias("at"), F.lit(0).alias("asks"), F.col("a").alias("edge")))
    after = starts.withColumn("next_start", F.min("edge").over(_by("rec", F.desc("at"), "asks"))).where("asks = 1").select("rec", "id", "next_start")
    rows = before.join(holding, ["rec", "id"]).join(after, ["rec", "id"]).where("reach IS NULL OR reach < b")
    lo = F.greatest(F.lit(0), F.col("a") - pad, F.coalesce("last_end", F.lit(0)))
    hi = F.least(F.col("b") + pad, F.coalesce("next_start", F.col("b") + pad))
    return rows.select("rec", "id", lo.alias("lo"), hi.alias("hi")).where("hi > lo")


def place_added(gaps: DataFrame, margin: int = 150, least: int = 800) -> DataFrame:
    """Where a block of ``words`` asked for ``at`` goes inside its gap (lo, hi): adds ``start`` and ``end``, null if there is no room.

    A margin stays free on both sides; words take their time at 2.9 a second and 400 ms, no words two seconds.
    """
    want = F.when(F.col("words") > 0, F.col("words") * 10_000 / 29 + 400).otherwise(2000)
    start = F.least(F.greatest("at", F.col("lo") + margin), F.col("hi") - margin - least)
    room = F.col("hi") - F.col("lo") - 2 * margin >= least
    rows = gaps.withColumn("start", F.when(room, start))
    return rows.withColumn("end", F.floor(F.least(F.col("hi") - margin, F.col("start") + F.greatest(F.lit(least), want))))


def part_offsets(parts: DataFrame) -> DataFrame:
    """Parts (rec, ord, duration) with where each begins when they are joined."""
    return parts.withColumn("begin", F.sum("duration").over(_by("rec", "ord").rowsBetween(Window.unboundedPreceding, 0)) - F.col("duration"))


def slivers(cleared: DataFrame, most: int = 250) -> DataFrame:
    """(rec, a, b): the pieces of at most ``most`` between ranges (rec, a, b) that follow each other."""
    following = F.lead("a").over(_by("rec", "a", "b"))
    return cleared.select("rec", F.col("b").alias("a"), following.alias("b")).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= most))


def pause_shares(pauses: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Pauses (rec, ord, length, delta) with the length that each gets so that all change by ``delta``: in proportion to what it can lose or take."""
    room = F.when(F.col("delta") < 0, F.greatest(F.lit(0), F.col("length") - shortest)).otherwise(F.greatest(F.lit(0), F.lit(longest) - F.col("length")))
    rows = pauses.withColumn("room", room).withColumn("all", F.sum("room").over(Window.partitionBy("rec")))
    share = F.when(F.col("all") > 0, F.col("room") / F.col("all") * F.least(F.abs("delta"), "all")).otherwise(0.0)
    return rows.withColumn("want", F.col("length") + F.when(F.col("delta") < 0, -share).otherwise(share)).drop("room", "all")


def without_groups(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Rows whose group is not held out; a row without a group stays."""
    return rows.join(held_out.select(key).distinct(), key, "left_anti")


def new_files(incoming: DataFrame, listed: DataFrame) -> DataFrame:
    """Incoming files that are not listed with the same name and size, in natural order: numbers in names count as numbers."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(name, '[0-9]+', 0) AS bigint)"), F.lit(0))
    fresh = incoming.join(listed.select("name", "size").distinct(), ["name", "size"], "left_anti")
    return fresh.withColumn("nth", F.row_number().over(Window.partitionBy("rec").orderBy(number, "name", "size")).cast("long"))


def review_set(suggested: DataFrame, noted: DataFrame) -> DataFrame:
    """(rec, id): lines with a suggestion or a note, once each."""
    return suggested.select("rec", "id").union(noted.select("rec", "id")).distinct()


def first_names(coined: DataFrame, terms: DataFrame, most: int = 8) -> DataFrame:
    """(rec, name, nth): distinct names (rec, ord, name) in order, coined ones first, ``most`` of each recording."""
    both = coined.select("rec", "name", F.lit(0).alias("list"), "ord").unionByName(terms.select("rec", "name", F.lit(1).alias("list"), "ord"))
    once = both.groupBy("rec", "name").agg(F.min(F.struct("list", "ord")).alias("at"))
    return once.withColumn("nth", F.row_number().over(_by("rec", "at", "name")).cast("long")).where(F.col("nth") <= most).select("rec", "name", "nth")


def candidate_metrics(takes: DataFrame, key: list[str]) -> DataFrame:
    """Takes (…, wrong, clicks, ms, pace) by candidate: how many are wrong, clicks a minute, mean and population deviation of the pace."""
    return takes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("takes"),
        F.sum(F.col("wrong").cast("long")).alias("wrong"),
        F.round(F.sum("clicks") * 60_000 / F.sum("ms"), 1).alias("clicks_per_min"),
        F.round(F.avg("pace"), 3).alias("pace"),
        F.round(F.stddev_pop("pace"), 3).alias("pace_sd"),
    )


def following_ids(bases: DataFrame, asked: DataFrame) -> DataFrame:
    """Names of blocks asked for (rec, n, at): the number of the last base (rec, id, start) before, or 0, and the next free letter; null beyond 26."""
    both = bases.select("rec", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("n"), F.col("id").alias("base"))
    both = both.unionByName(asked.select("rec", "at", F.lit(0).alias("kind"), "n", F.lit(None).cast("long").alias("base")))
    # of equal times the request comes first: a base has to begin before it
    placed = both.withColumn("base", F.last("base", ignorenulls=True).over(_by("rec", "at", "kind", "base").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 0")
    named = placed.withColumn("base", F.coalesce("base", F.lit(0))).withColumn("nth", F.row_number().over(Window.partitionBy("rec", "base").orderBy("n")))
    return named.select("rec", "n", "base", F.when(F.col("nth") <= 26, F.char(96 + F.col("nth"))).alias("letter"))


def unslice(slices: DataFrame, cuts: DataFrame, asked: DataFrame, near: int = 350) -> DataFrame:
    """(rec, at, slice): of each time asked for, the nearest slice within ``near`` that bounds no cut; of equally near ones the later.

    Times meet in buckets of twice ``near``, so that a slice meets requests of its own and the neighbouring buckets only.
    """
    width = 2 * near
    bounds = cuts.select("rec", F.explode(F.array("a", "b")).alias("slice")).distinct()
    free = slices.select("rec", F.col("at").alias("slice")).distinct().join(bounds, ["rec", "slice"], "left_anti")
    free = free.withColumn("bucket", F.floor(F.col("slice") / width))
    wide = asked.select("rec", "at", F.explode(F.sequence(F.floor((F.col("at") - near) / width), F.floor((F.col("at") + near) / width))).alias("bucket"))
    met = wide.join(free, ["rec", "bucket"]).where(F.abs(F.col("slice") - F.col("at")) <= near)
    return met.groupBy("rec", "at").agg(F.min_by("slice", F.struct(F.abs(F.col("slice") - F.col("at")), -F.col("slice"))).alias("slice"))


def rejoined(ranges: DataFrame) -> DataFrame:
    """Ranges (rec, ord, a, b, abandoned) made one across every junction that is abandoned, which is that before the range."""
    joins = F.col("abandoned") & F.lag("ord").over(_by("rec", "ord")).isNotNull()
    island = F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(_by("rec", "ord"))
    return ranges.withColumn("joins", joins).withColumn("island", island).groupBy("rec", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def reset_tweaks(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines named by id without stretch, offset and hold."""
    named = lines.join(ids.select("id", F.lit(True).alias("_named")).distinct(), "id", "left")
    reset = {"stretch_milli": 1000, "offset": 0, "hold": 0}
    return named.withColumns({c: F.when(F.col("_named"), F.lit(v).cast("long")).otherwise(F.col(c)) for c, v in reset.items()}).drop("_named")


def speaking(frames: DataFrame, least: int, hole: int) -> DataFrame:
    """(rec, live): frames (rec, k, v) above ``least`` in size, with the holes of at most ``hole`` frames between them."""
    live = frames.where(F.abs("v") > least).withColumn("gap", F.col("k") - F.lag("k").over(_by("rec", "k")) - 1)
    return live.groupBy("rec").agg((F.count(F.lit(1)) + F.sum(F.when(F.col("gap").between(1, hole), F.col("gap")).otherwise(0))).alias("live"))
