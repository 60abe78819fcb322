"""Queries over frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import frames as ops
from timeloom.sources import fixtures as fx

from .registry import query
from .views import FRAMES

LEVELS = "levels AS (SELECT rec, k // 8 AS win, CAST(sum(v * v) AS BIGINT) AS energy FROM frames GROUP BY 1, 2)"
INDEX = "list_sort(list({c}))[CAST(least(count(*) - 1, floor(count(*) * {q})) AS BIGINT) + 1]"


@query(f"WITH {FRAMES}, {LEVELS} SELECT * FROM levels")
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.levels(fx.frames(spark, sf_dir))


@query(f"WITH {FRAMES}, {LEVELS} SELECT rec, {INDEX.format(c='energy', q=0.75)} AS level, {INDEX.format(c='energy', q=0.1)} AS floor FROM levels GROUP BY rec")
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.speech_level(ops.levels(fx.frames(spark, sf_dir)))


@query(f"""WITH {FRAMES}, a AS (SELECT *, abs(v) >= 200 AS loud FROM frames), g AS (SELECT *, k - row_number() OVER (PARTITION BY rec, loud ORDER BY k) AS run FROM a),
r AS (SELECT rec, loud, run, count(*) AS n, max(abs(v)) AS peak, count(*) FILTER (v = 0) AS zeros FROM g GROUP BY 1, 2, 3)
SELECT rec, max(peak) AS peak, CAST(sum(CASE WHEN loud THEN n ELSE 0 END) AS BIGINT) AS over, max(CASE WHEN loud THEN n ELSE 0 END) AS longest_over, CAST(sum(zeros) AS BIGINT) AS zeros FROM r GROUP BY rec""")
def clip_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.profile(fx.frames(spark, sf_dir), 200)


@query(f"""WITH {FRAMES}, {LEVELS}, s AS (SELECT rec, {INDEX.format(c='energy', q=0.1)} AS floor, max(energy) AS peak, max(win) AS last_win FROM levels GROUP BY rec HAVING count(*) >= 3),
q AS (SELECT l.rec, win, last_win, win - row_number() OVER (PARTITION BY l.rec ORDER BY win) AS run FROM levels l JOIN s USING (rec) WHERE energy < 9 * greatest(floor, 1) AND 10 * energy < 4 * peak)
SELECT rec, min(win) AS first, max(win) AS last FROM q GROUP BY rec, run, last_win HAVING max(win) - min(win) + 1 >= 2 AND min(win) > 0 AND max(win) < last_win""")
def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.quiet_runs(ops.levels(fx.frames(spark, sf_dir)))


@query(f"WITH {FRAMES} SELECT rec, k, CAST(sum(v) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM frames WINDOW w AS (PARTITION BY rec ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def moving_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.moving_sum(fx.frames(spark, sf_dir))


@query(f"WITH {FRAMES}, p AS (SELECT *, greatest(count(*) OVER (PARTITION BY rec) // 10, 1) AS per FROM frames) SELECT rec, least(k // per, 9) AS bucket, max(abs(v)) AS peak FROM p GROUP BY 1, 2")
def peak_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peaks(fx.frames(spark, sf_dir), 10)


@query(f"WITH {FRAMES}, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY rec) AS peak FROM frames) SELECT rec, min(k) AS first, max(k) AS last FROM p WHERE abs(v) >= 0.5 * peak GROUP BY rec")
def speech_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extent(fx.frames(spark, sf_dir))


@query(f"""WITH {FRAMES}, w AS (SELECT rec, k, v, list(abs(v)) OVER (PARTITION BY rec ORDER BY k ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS near FROM frames)
SELECT rec, k FROM w WHERE abs(v) > 3 * list_sort(near)[CAST(least(len(near) - 1, floor(len(near) * 0.5)) AS BIGINT) + 1]""")
def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.spikes(fx.frames(spark, sf_dir))


@query(f"""WITH {FRAMES}, s AS (SELECT rec, abs(v - lag(v) OVER (PARTITION BY rec ORDER BY k)) AS step FROM frames)
SELECT rec, {INDEX.format(c='step', q=0.5)} AS jitter FROM s WHERE step IS NOT NULL GROUP BY rec""")
def frame_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.jitter(fx.frames(spark, sf_dir))


@query(f"""WITH {FRAMES}, {LEVELS}, q AS (SELECT rec, win, win - row_number() OVER (PARTITION BY rec ORDER BY win) AS run FROM levels WHERE win >= 2 AND energy < 120000)
SELECT rec, min(win) AS win FROM (SELECT rec, run, min(win) AS win FROM q GROUP BY rec, run HAVING count(*) >= 2) GROUP BY rec""")
def quiet_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.quiet_from(ops.levels(fx.frames(spark, sf_dir)), 2, 120_000, 2)


@query(f"""WITH {FRAMES}, e AS (SELECT *, max(k) OVER (PARTITION BY rec) - k < 16 AS late FROM frames)
SELECT rec, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS spread, round(regr_slope(v, k) FILTER (WHERE late), 4) AS slope FROM e GROUP BY rec""")
def phrase_prosody(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prosody(fx.frames(spark, sf_dir)).select("rec", "median", "spread", F.round("slope", 4).alias("slope"))
