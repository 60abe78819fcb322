"""Reports: metrics before and after, the worst findings of each kind, and reasons in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_metrics(rows: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """(key, metric, value): a row for each metric of a row; nulls stay."""
    return rows.select(*key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, metrics, "metric", "value")


def before_after(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, metric, before, after, delta, change) of two tables (key, metric, value); a metric that only one has is ``new`` or ``gone``, else better or worse is up to the reader: ``same``, ``up`` or ``down``."""
    both = before.select(*key, "metric", F.col("value").alias("before"), F.lit(True).alias("_b")).join(after.select(*key, "metric", F.col("value").alias("after"), F.lit(True).alias("_a")), [*key, "metric"], "full_outer")
    delta = F.col("after") - F.col("before")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("before").eqNullSafe(F.col("after")), "same").when(delta > 0, "up").when(delta < 0, "down")
    return both.select(*key, "metric", "before", "after", delta.alias("delta"), change.alias("change"))


def first_of_each(rows: DataFrame, group: list[str], order: list[Column], most: int = 6) -> DataFrame:
    """The first rows of each group, with their ``place`` and how many the group has in all."""
    w = Window.partitionBy(*group)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(*order)).cast("long"), "of": F.count(F.lit(1)).over(w)}).where(F.col("place") <= most)


def why_failed(must_say: Column, why: Column, tail: Column, score: Column, heard: Column) -> Column:
    """The reason of a failed take in words: names that were said wrong (wanted, heard), a tail that went on, else what was heard, sixty characters of it."""
    names = F.array_join(F.transform(must_say, lambda m: F.concat(F.lit('said "'), m["heard"], F.lit('" for "'), m["wanted"], F.lit('"'))), ", ")
    went_on = F.concat(F.lit("said the line, then kept making sound (tail "), tail.cast("string"), F.lit(" dB)"))
    other = F.concat(F.lit("did not say the line ("), score.cast("string"), F.lit('): "'), F.substring(F.coalesce(heard, F.lit("")), 1, 60), F.lit('"'))
    return F.when(F.coalesce(F.size(must_say), F.lit(0)) > 0, names).when(why == "tail", went_on).otherwise(other)


def settings_for(pace: Column, project_pace: Column, direction: Column, project_direction: Column) -> Column:
    """What holds for a line: its own pace unless that is missing or 0, and its own direction unless that is missing, trimmed."""
    return F.struct(F.coalesce(F.nullif(pace, F.lit(0)), project_pace).alias("pace"), F.trim(F.coalesce(direction, project_direction, F.lit(""))).alias("direction"))


def noisy(tail: Column, flat_ms: Column, pause: Column, loud_tail: int = -800, flat: int = 2, loud_pause: int = 1200) -> Column:
    """Faults of a take's sound, levels in hundredths of a decibel: a tail above the body's limit, flat tops of some milliseconds, a pause that rises too far."""
    return F.array_compact(F.array(F.when(tail > loud_tail, F.lit("tail")), F.when(flat_ms >= flat, F.lit("clipped")), F.when(pause >= loud_pause, F.lit("pause"))))


def trimmed_end(length: Column, quiet_from: Column, least: int = 600, share: float = 0.55, least_cut: int = 300) -> Column:
    """Where to end a take whose tail is quiet from some time on, in milliseconds; its length where the cut is refused: too small, or too little left."""
    fine = (length - quiet_from >= least_cut) & (quiet_from >= least) & (quiet_from >= share * length)
    return F.when(quiet_from.isNull() | ~fine, length).otherwise(quiet_from)


def joined_arithmetic(parts: DataFrame, whole: DataFrame, slack: int = 40) -> DataFrame:
    """(rec, parts, total, length, fine): whether a joined file (rec, length) is as long as its parts (rec, part, length) together, within ``slack`` a part."""
    sums = parts.groupBy("rec").agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("total"))
    both = whole.join(sums, "rec", "left").select("rec", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("total", F.lit(0)).alias("total"), "length")
    return both.withColumn("fine", F.abs(F.col("length") - F.col("total")) <= slack * F.col("parts"))


def kept_clips(read: DataFrame, mined: DataFrame, shortest: float = 1.2, longest: float = 18.0, words: int = 3, least: int = 40) -> DataFrame:
    """Clips (audio, text, seconds, source) of both corpora that are neither too short, too long nor of too few words; an error where fewer than ``least`` are left."""
    rows = read.unionByName(mined)
    rows = rows.where(F.col("seconds").between(shortest, longest) & (F.regexp_count("text", F.lit("[^ \t\n\r]+")) >= words))
    found = rows.limit(least).count()
    if found < least:
        raise ValueError(f"{found} usable clips, {least} needed")
    return rows


def snapped(ranges: DataFrame, per_frame: float) -> DataFrame:
    """(rec, a, b, first, frames): ranges in milliseconds on the frame grid, those of one and a half frames or less left out."""
    rows = ranges.where(F.col("b") - F.col("a") > 1.5 * per_frame)
    first, last = F.round(F.col("a") / per_frame).cast("long"), F.round(F.col("b") / per_frame).cast("long")
    return rows.select("rec", "a", "b", first.alias("first"), F.greatest(F.lit(1), last - first).alias("frames"))


def fit_grid(width: Column, height: Column, fps: Column, most: int = 850_000, cell: int = 16) -> Column:
    """Width and height whose blocks of ``cell`` pixels a second are within ``most``: as they are if that fits, else on the grid, from the scaled
    width downward the first that fits or is 640 or less; at least 320 by 176."""
    blocks = lambda w, h: F.floor(w / cell) * F.floor((h + cell - 1) / cell) * fps
    start = F.greatest(F.lit(320), F.floor(F.floor(width * F.sqrt(most / blocks(width, height))) / cell) * cell).cast("long")
    last = F.when(start > 640, start - cell * F.ceil((start - 640) / cell)).otherwise(start).cast("long")
    tall = lambda w: F.greatest(F.lit(176), F.floor(F.bround(w * height / width) / cell) * cell).cast("long")
    fitting = F.filter(F.sequence(start, last, F.lit(-cell).cast("long")), lambda w: blocks(w, tall(w)) <= most)
    chosen = F.coalesce(F.get(fitting, F.lit(0)), last)
    whole = F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))
    return F.when(blocks(width, height) <= most, whole).otherwise(F.struct(chosen.alias("width"), tall(chosen).alias("height")))


def duckable(spans: DataFrame, keep: DataFrame, levels: DataFrame, shortest: int = 60, least: int = -4500) -> DataFrame:
    """(rec, id, a, b, peak): spans whose middle lies in a kept range (rec, a, b), of ``shortest`` milliseconds or more, whose loudest level (rec, k, level, in hundredths of a decibel, one a frame of ``spans``' unit) is ``least`` or more.

    Both meetings are in buckets; a span beyond the frames that there are has none.
    """
    width = 1 << 16
    middle = F.floor((F.col("a") + F.col("b")) / 2)
    kept = keep.select("rec", F.col("a").alias("_a"), F.col("b").alias("_b"), F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))).alias("_bucket"))
    long = spans.where(F.col("b") - F.col("a") >= shortest).withColumn("_bucket", F.floor(middle / width))
    inside = long.join(kept, (long["rec"] == kept["rec"]) & (long["_bucket"] == kept["_bucket"]) & (2 * F.col("_a") <= F.col("a") + F.col("b")) & (F.col("a") + F.col("b") <= 2 * F.col("_b")), "left_semi").drop("_bucket")
    block = 256
    parts = inside.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))))
    heard = parts.join(levels.select("rec", "k", "level", F.floor(F.col("k") / block).alias("_bucket")), ["rec", "_bucket"]).where("k BETWEEN a AND b")
    frames = levels.groupBy("rec").agg(F.max("k").alias("_last"))
    peaks = heard.groupBy("rec", "id", "a", "b").agg(F.max("level").alias("peak")).where(F.col("peak") >= least)
    return peaks.join(frames, "rec").where("a >= 0 AND b <= _last").drop("_last")
