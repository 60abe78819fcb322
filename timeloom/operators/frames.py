"""Measures over frame tables (rec, k, v): levels, runs, moving gain, peaks, percentiles and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _order() -> WindowSpec:
    return Window.partitionBy("rec").orderBy("k")


def pct_index(values: Column, q: float) -> Column:
    """The value at index floor(n * q) of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * q)).cast("int"))


def index_values(rows: DataFrame, value: str, **shares: float) -> DataFrame:
    """(rec, …): for each name the value at index floor(n * share) of a recording's sorted values; nulls are the highest.

    Rows are numbered by a window, which spills, so that a recording may have any number of them.
    """
    ranked = rows.select("rec", F.col(value).alias("value"), F.row_number().over(Window.partitionBy("rec").orderBy(F.asc_nulls_last(value))).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("rec")).alias("n"))
    place = lambda q: F.least(F.col("n"), F.floor(F.col("n") * q) + 1)
    return ranked.groupBy("rec").agg(*[F.max(F.when(F.col("nth") == place(q), F.col("value"))).alias(name) for name, q in shares.items()])


def levels(frames: DataFrame, window: int = 8) -> DataFrame:
    """(rec, win, energy): sum of squares in fixed windows; the rest that fills no window counts as one."""
    return frames.groupBy("rec", F.floor(F.col("k") / window).alias("win")).agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


def speech_level(levels: DataFrame, q: float = 0.75) -> DataFrame:
    """(rec, level, floor): index percentiles of the window energies."""
    return index_values(levels, "energy", level=q, floor=0.1)


def profile(frames: DataFrame, ceiling: int) -> DataFrame:
    """(rec, peak, over, longest_over, zeros): highest magnitude, samples at the ceiling, their longest run, and zeros."""
    at = F.abs("v") >= ceiling
    rows = frames.withColumn("at", at).withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("rec", "at").orderBy("k")))
    runs = rows.groupBy("rec", "at", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("peak"), F.count_if(F.col("v") == 0).alias("zeros"))
    return runs.groupBy("rec").agg(
        F.max("peak").alias("peak"), F.sum(F.when(F.col("at"), F.col("n")).otherwise(0)).alias("over"),
        F.max(F.when(F.col("at"), F.col("n")).otherwise(0)).alias("longest_over"), F.sum("zeros").alias("zeros"),
    )


def quiet_runs(levels: DataFrame, least: int = 2) -> DataFrame:
    """(rec, first, last): interior runs of ``least`` windows or more below min(3 * floor, peak / 50), with the 10 % index floor.

    Recordings of fewer than three windows have none.
    """
    stats = levels.groupBy("rec").agg(F.max("energy").alias("peak"), F.max("win").alias("end"), F.count(F.lit(1)).alias("n"))
    rows = levels.join(stats.where("n >= 3"), "rec").join(index_values(levels, "energy", floor=0.1), "rec")
    quiet = rows.where((F.col("energy") < 9 * F.greatest("floor", F.lit(1))) & (10 * F.col("energy") < 4 * F.col("peak")))
    runs = quiet.withColumn("run", F.col("win") - F.row_number().over(Window.partitionBy("rec").orderBy("win"))).groupBy("rec", "run", "end").agg(F.min("win").alias("first"), F.max("win").alias("last"))
    return runs.where((F.col("last") - F.col("first") + 1 >= least) & (F.col("first") > 0) & (F.col("last") < F.col("end"))).select("rec", "first", "last")


def moving_sum(frames: DataFrame, radius: int = 3) -> DataFrame:
    """(rec, k, total, n): sums over a window that shrinks at the edges; their quotient is the moving average."""
    near = _order().rowsBetween(-radius, radius)
    return frames.select("rec", "k", F.sum("v").over(near).alias("total"), F.count(F.lit(1)).over(near).alias("n"))


def peaks(frames: DataFrame, columns: int = 16) -> DataFrame:
    """(rec, bucket, peak): the highest magnitude in each of ``columns`` equal buckets; the rest goes to the last one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("rec"))
    rows = frames.withColumn("per", F.greatest(F.floor(n / columns), F.lit(1)))
    return rows.groupBy("rec", F.least(F.floor(F.col("k") / F.col("per")), F.lit(columns - 1)).alias("bucket")).agg(F.max(F.abs("v")).alias("peak"))


def extent(frames: DataFrame, share: float = 0.5) -> DataFrame:
    """(rec, first, last): the first and last frame that reach a share of the peak."""
    rows = frames.withColumn("peak", F.max(F.abs("v")).over(Window.partitionBy("rec"))).where(F.abs("v") >= share * F.col("peak"))
    return rows.groupBy("rec").agg(F.min("k").alias("first"), F.max("k").alias("last"))


def spikes(frames: DataFrame, factor: int = 3, radius: int = 10) -> DataFrame:
    """(rec, k): magnitudes above ``factor`` times the middle one of the window around them."""
    near = _order().rowsBetween(-radius, radius - 1)
    middle = pct_index(F.collect_list(F.abs("v")).over(near), 0.5)
    return frames.withColumn("middle", middle).where(F.abs("v") > factor * F.col("middle")).select("rec", "k")


def prosody(frames: DataFrame, tail: int = 16) -> DataFrame:
    """(rec, median, spread, slope): linear median and inter-quartile range, and the least-squares slope of the last frames."""
    from_end = F.max("k").over(Window.partitionBy("rec")) - F.col("k")
    rows = frames.withColumn("from_end", from_end)
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    late = F.col("from_end") < tail
    slope = F.regr_slope(F.when(late, F.col("v")), F.when(late, F.col("k")))
    return rows.groupBy("rec").agg(q.alias("q"), slope.alias("slope")).select("rec", F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("spread"), "slope")


def jitter(frames: DataFrame) -> DataFrame:
    """(rec, jitter): the upper median of the steps between neighbouring frames."""
    steps = frames.withColumn("step", F.abs(F.col("v") - F.lag("v").over(_order()))).where("step IS NOT NULL")
    return index_values(steps, "step", jitter=0.5)


def quiet_from(levels: DataFrame, start: int, below: int, least: int = 3) -> DataFrame:
    """(rec, win): where the first run of ``least`` windows below a level begins, at ``start`` or later."""
    rows = levels.where((F.col("win") >= start) & (F.col("energy") < below))
    runs = rows.withColumn("run", F.col("win") - F.row_number().over(Window.partitionBy("rec").orderBy("win"))).groupBy("rec", "run").agg(F.min("win").alias("win"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).groupBy("rec").agg(F.min("win").alias("win"))
