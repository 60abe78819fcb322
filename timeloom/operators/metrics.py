"""Rollups per recording: fault metrics, edit-plan figures and segments worth a re-read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import constants as C


def recording_metrics(words: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per recording with words: counts by kind, pace over the speech span, and dead air; whole numbers only."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    long = F.when(F.col("kind") == "gap", F.col("end_ms") - F.col("start_ms"))
    by_kind = flags.groupBy("rec").agg(
        count("filler").alias("fillers"), count("soft_filler").alias("soft_fillers"), count("low_conf").alias("low_conf"), count("gap").alias("gap_count"),
        F.coalesce(F.sum(long), F.lit(0)).alias("gap_ms"), F.coalesce(F.max(long), F.lit(0)).alias("longest_gap_ms"),
    )
    rows = words.groupBy("rec").agg(F.count(F.lit(1)).alias("words"), (F.max("end_ms") - F.min("start_ms")).alias("speech_ms")).join(by_kind, "rec", "left")
    rows = rows.fillna(0)
    span = F.greatest("speech_ms", F.lit(1))
    return rows.withColumns({
        "wpm": F.floor(F.col("words") * 60_000 / span + 0.5),
        "fillers_per_hour": F.floor(F.col("fillers") * 3_600_000 / span + 0.5),
        "gap_permille": F.floor(1000 * F.col("gap_ms") / span + 0.5),
    })


def metrics_rollup(words: DataFrame, flags: DataFrame, by: DataFrame) -> DataFrame:
    """An extension: flag counts by (class, rec), by class and in total; ``by`` gives the class of each recording."""
    counts = flags.groupBy("rec").agg(F.count(F.lit(1)).alias("flags"))
    rows = words.groupBy("rec").agg(F.count(F.lit(1)).alias("words")).join(counts, "rec", "left").join(by, "rec")
    return rows.rollup("class", "rec").agg(F.sum("words").alias("words"), F.sum(F.coalesce("flags", F.lit(0))).alias("flags"))


def plan_rollup(words: DataFrame, keep: DataFrame, target: int = 145) -> DataFrame:
    """Kept time, pace after the cuts, suggested tempo in permille (1000 to 1250) and number of ranges."""
    kept = keep.groupBy("rec").agg(F.sum(F.col("b") - F.col("a")).alias("kept_ms"), F.count(F.lit(1)).alias("ranges"))
    rows = words.groupBy("rec").agg(F.count(F.lit(1)).alias("words"), F.max("end_ms").alias("duration_ms")).join(kept, "rec", "left").fillna(0)
    wpm = F.when(F.col("kept_ms") > 0, F.floor(F.col("words") * 60_000 / F.col("kept_ms") + 0.5)).otherwise(0)
    rows = rows.withColumn("wpm", wpm)
    tempo = F.when(F.col("wpm") > 0, F.least(F.greatest(F.floor(target * 1000 / F.col("wpm") + 0.5), F.lit(1000)), F.lit(1250))).otherwise(1000)
    return rows.withColumn("tempo_permille", tempo.cast("long"))


def first_segment(flags: DataFrame, segments: DataFrame, slack: int = 10) -> DataFrame:
    """Flags with ``seg``, the first segment that holds their start, ``slack`` wider on both sides; the others go.

    Segments of a recording lie in order, so the first that ends late enough is found by a
    range join whose equi key is the recording and a bucket of its time.
    """
    width = 60_000
    y = segments.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start_ms") - slack) / width), F.floor((F.col("end_ms") + slack) / width)))).alias("y")
    x = flags.withColumn("bucket", F.floor(F.col("start_ms") / width)).alias("x")
    on = (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & F.col("x.start_ms").between(F.col("y.start_ms") - slack, F.col("y.end_ms") + slack)
    met = x.join(y, on).select("x.*", F.col("y.seg").alias("seg")).drop("bucket")
    return met.groupBy(*flags.columns).agg(F.min("seg").alias("seg"))


def pickups(flags: DataFrame, segments: DataFrame, least: float = 2.0, most: int = 40) -> DataFrame:
    """The ``most`` worst segments of each recording by weighted faults, in order of time, with ids 001 and on."""
    weight = F.lit(0.0)
    for kind, value in C.FAULT_WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, value).otherwise(weight)
    located = first_segment(flags.where(F.col("kind").isin(list(C.FAULT_WEIGHTS))), segments)
    scored = located.groupBy("rec", "seg").agg(
        F.sum(weight).alias("score"),
        F.min(F.struct("start_ms", "kind", "idx")).alias("first"),
        F.array_join(F.slice(F.array_sort(F.collect_set("detail")), 1, 4), "|").alias("reasons"),
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"),
    ).where(F.col("score") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("score"), "first"))).where(F.col("rank") <= most)
    ranked = ranked.join(segments, ["rec", "seg"])
    number = F.row_number().over(Window.partitionBy("rec").orderBy("start_ms", "seg"))
    return ranked.select("rec", "seg", "score", "reasons", "kinds", F.lpad(number.cast("string"), 3, "0").alias("id"))


def status_counts(lines: DataFrame) -> DataFrame:
    """Lines by state of each recording: total, dropped, locked, and those still open."""
    return lines.groupBy("rec").agg(F.count(F.lit(1)).alias("total"), F.count_if("dropped").alias("dropped"), F.count_if(F.col("locked") & ~F.col("dropped")).alias("locked"), F.count_if(~F.col("locked") & ~F.col("dropped")).alias("open"))
