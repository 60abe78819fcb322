"""Edit plans over timed words and placed lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as t


def keep_ranges(words: DataFrame, dropped: DataFrame, durations: DataFrame | None = None, gap_most: int = 600, gap_keep: int = 300, splice: int = 30, head: int = 250, tail: int = 400, least: int = 20) -> DataFrame:
    """(rec, ord, a, b): what stays of each recording without the ``dropped`` words (rec, idx) and without long gaps.

    A range breaks where a dropped word lies between two kept ones (padded by ``splice``) or
    where their gap is above ``gap_most`` (padded by half of ``gap_keep``); no pad takes more
    than 45 % of the gap. Durations (rec, duration) bound the tail; without them the last
    word's end does.
    """
    order = Window.partitionBy("rec").orderBy("idx")
    kept = words.join(dropped.select("rec", "idx").distinct(), ["rec", "idx"], "left_anti")
    rows = kept.select("rec", "idx", "start_ms", "end_ms", F.lag("idx").over(order).alias("p_idx"), F.lag("end_ms").over(order).alias("p_end"))
    gap = F.col("start_ms") - F.col("p_end")
    cut = F.col("idx") - F.col("p_idx") > 1
    pad = F.when(cut, F.least(F.lit(splice), F.floor(0.45 * F.greatest(gap, F.lit(0))))).when(gap > gap_most, F.least(F.lit(gap_keep // 2), F.floor(0.45 * gap)))
    rows = rows.withColumn("pad", pad).withColumn("fresh", F.col("p_idx").isNull() | F.col("pad").isNotNull())
    rows = rows.withColumn("island", F.sum(F.col("fresh").cast("int")).over(order)).withColumn("n_pad", F.lead("pad").over(order)).withColumn("last", F.lead("idx").over(order).isNull())
    begin = F.when(F.col("p_idx").isNull(), F.greatest(F.lit(0), F.col("start_ms") - head)).otherwise(F.col("start_ms") - F.col("pad"))
    rows = rows.withColumn("begin", F.when(F.col("fresh"), begin))
    rows = rows.withColumn("close", F.when(F.col("last"), F.col("end_ms") + tail).otherwise(F.col("end_ms") + F.col("n_pad")))
    ranges = rows.groupBy("rec", "island").agg(F.max("begin").cast("long").alias("a"), F.max_by("close", "idx").cast("long").alias("b"))
    if durations is None:
        durations = words.groupBy("rec").agg(F.max("end_ms").alias("duration"))
    ranges = ranges.join(durations, "rec").withColumn("b", F.least("b", "duration")).where(F.col("b") - F.col("a") > least)
    return ranges.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("a", "island")) - 1).cast("long").alias("ord"), "a", "b")


def filler_spans(flags: DataFrame, widen: int = 20) -> DataFrame:
    """Hard fillers as intervals, a little wider."""
    return flags.where("kind = 'filler'").select("rec", F.greatest(F.lit(0), F.col("start_ms") - widen).alias("a"), (F.col("end_ms") + widen).alias("b"))


def sentence_requests(words: DataFrame, least_words: int = 3, least_ms: int = 500) -> DataFrame:
    """(rec, chunk, first, last, start_ms, end_ms, text): sentences of kept words; a short one flows into the next.

    Chunks are numbered before those that are too short in words or time are left out. Words
    are counted by piece, a piece ending with a closing word; only these counts are
    gathered by recording, and a running count that starts again with every full chunk numbers them.
    """
    closes = F.col("w").rlike("[.!?]$").cast("int")
    order = Window.partitionBy("rec").orderBy("idx")
    pieces = words.select("rec", "idx", "w", "start_ms", "end_ms").withColumn("closes", closes).withColumn("piece", F.sum("closes").over(order) - F.col("closes"))
    counts = pieces.groupBy("rec", "piece").agg(F.struct(F.col("piece"), F.count(F.lit(1)).alias("n")).alias("c")).groupBy("rec").agg(F.array_sort(F.collect_list("c")).alias("counts"))
    zero = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("chunk"), F.array().cast("array<bigint>").alias("chunks"))

    def count(state: Column, c: Column) -> Column:
        held = state["held"] + c["n"]
        full = held >= least_words
        return F.struct(F.when(full, 0).otherwise(held).cast("long").alias("held"), (state["chunk"] + full.cast("long")).alias("chunk"), F.concat(state["chunks"], F.array(state["chunk"])).alias("chunks"))

    chunks = counts.select("rec", F.explode(F.arrays_zip(F.col("counts.piece").alias("piece"), F.aggregate("counts", zero, count)["chunks"].alias("chunk"))).alias("c")).select("rec", "c.piece", "c.chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda x: x["w"]), " ")
    made = pieces.join(chunks, ["rec", "piece"]).groupBy("rec", "chunk").agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), text.alias("text")
    )
    return made.where((t.word_count(F.col("text")) >= least_words) & (F.col("end_ms") - F.col("start_ms") >= least_ms))


def repair_spans(words: DataFrame, seeds: DataFrame, pause: int = 180, most: int = 4000) -> DataFrame:
    """(rec, first, last): each seed word (rec, idx) grown to the nearest pause on its left, then right, within ``most`` ms.

    A word that one span has taken is no part of another. Pauses cut a recording into islands,
    and no span leaves its island; in it, the limits are found in the sorted times. Islands
    without a seed are left out.
    """
    order = Window.partitionBy("rec").orderBy("idx")
    rows = words.select("rec", "idx", "start_ms", "end_ms").withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(order))
    rows = rows.withColumn("island", F.sum(F.when(F.col("gap") < pause, 0).otherwise(1)).over(order))
    rows = rows.join(seeds.select("rec", "idx", F.lit(True).alias("seed")).distinct(), ["rec", "idx"], "left")
    words_of = F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", F.coalesce("seed", F.lit(False)).alias("seed"))))
    islands = rows.groupBy("rec", "island").agg(words_of.alias("words"), F.max(F.coalesce("seed", F.lit(False))).alias("any")).where("any")

    @F.pandas_udf("array<struct<first:bigint,last:bigint>>")
    def grown(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            idx, start, end, seed = (np.array([w[c] for w in group]) for c in ("idx", "start_ms", "end_ms", "seed"))
            spans, free = [], 0
            for at in np.flatnonzero(seed):
                if at >= free:
                    first = max(free, int(np.searchsorted(start[: at + 1], end[at] - most, "right")))
                    first = min(first, at)
                    free = max(at + 1, int(np.searchsorted(end, start[first] + most, "left")))
                    spans.append({"first": int(idx[first]), "last": int(idx[free - 1])})
            out.append(spans)
        return pd.Series(out)

    return islands.select("rec", F.explode(grown("words")).alias("s")).select("rec", "s.first", "s.last")


def place(lines: DataFrame, margin: int = 20) -> DataFrame:
    """(rec, ord, at, until): lines laid out in order, none over the end of the one before or the asked-for start of the next.

    A line is asked for at its start and its ``offset``, if the table has one. Dropped lines have an empty place at their start,
    locked ones their own. What the line before was given pushes a line on; that recursion is a running maximum once the lengths
    before a line are taken off, anew behind each line that has its place, so windows solve it.
    """
    asked = F.col("start") + (F.coalesce("offset", F.lit(0)) if "offset" in lines.columns else F.lit(0))
    order = Window.partitionBy("rec").orderBy("ord")
    rows = lines.select("rec", "ord", "start", "end", "len", "dropped", (F.col("dropped") | F.col("locked")).alias("fixed"), asked.alias("asked"), F.coalesce(F.lead(asked).over(order) - margin, F.col("end") + F.col("len")).alias("high"), F.row_number().over(order).alias("nth"))
    rows = rows.withColumn("run", F.sum(F.col("fixed").cast("int")).over(order))
    run = Window.partitionBy("rec", "run").orderBy("ord")
    before = F.coalesce(F.sum(F.when(~F.col("fixed"), F.col("len") + margin)).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    wanted = F.least("asked", "high")
    until = F.when(F.col("dropped"), F.col("start")).otherwise(F.col("end"))
    own = F.when(F.col("fixed"), until + margin).when(F.col("nth") == 1, F.greatest(F.lit(0), wanted)).otherwise(wanted - F.col("before"))
    rows = rows.withColumn("at", F.when(F.col("fixed"), F.col("start")).otherwise(F.max(own).over(run) + F.col("before")))
    return rows.select("rec", "ord", "at", F.when(F.col("fixed"), until).otherwise(F.col("at") + F.col("len")).alias("until"))


def cues(rows: DataFrame, width: int = 42, most_rows: int = 2, most_ms: int = 6000) -> DataFrame:
    """(rec, ord, part, a, b, text): captions of (rec, ord, a, b, text), of at most two rows each.

    A longer text is split into chunks of two rows that share its time by their words; each
    cue ends where the next begins at the latest.
    """
    wrapped = rows.where(F.trim("text") != "").withColumn("rows", t.wrap(F.col("text"), width))
    chunks = F.transform(F.sequence(F.lit(1), F.size("rows"), F.lit(most_rows)), lambda i: F.slice("rows", i, F.lit(most_rows)))
    whole = (F.size("rows") <= most_rows) & (F.col("b") - F.col("a") <= most_ms)
    split = wrapped.select("rec", "ord", "a", "b", F.posexplode(F.when(whole, F.array("rows")).otherwise(chunks)).alias("part", "chunk"))
    inner = Window.partitionBy("rec", "ord")
    split = split.withColumn("n", t.word_count(F.array_join("chunk", " "))).withColumn("total", F.sum("n").over(inner)).withColumn("done", F.sum("n").over(inner.orderBy("part")) - F.col("n"))
    span = F.greatest(F.lit(100), F.col("b") - F.col("a"))
    at = lambda n: F.col("a") + F.floor(span * n / F.col("total"))
    timed = split.select("rec", "ord", "part", at(F.col("done")).alias("c"), F.least(at(F.col("done") + F.col("n")), F.col("b")).alias("d"), F.array_join("chunk", "\n").alias("text"))
    following = F.lead("c").over(Window.partitionBy("rec").orderBy("c", "ord", "part"))
    return timed.select("rec", "ord", F.col("part").cast("long").alias("part"), F.col("c").alias("a"), F.least("d", F.coalesce(following, "d")).alias("b"), "text")
