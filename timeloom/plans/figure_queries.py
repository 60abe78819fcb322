"""Queries over figures of takes, clips and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import figures as ops
from timeloom.operators import frames as fr
from timeloom.sources import fixtures as fx

from .registry import query
from .signal_queries import INDEX, LEVELS
from .text_queries import SENTENCES
from .views import FRAMES, LINES, SCRIPTED, SPANS, TAKES, squash

PEAKS = "per AS (SELECT *, greatest(count(*) OVER (PARTITION BY rec) // 16, 1) AS n FROM frames), peaks AS (SELECT rec, least(k // n, 15) AS bucket, max(abs(v)) AS peak FROM per GROUP BY 1, 2)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.levels(fx.frames(spark, sf_dir))


@query(
    f"""WITH {FRAMES}, s AS (SELECT DISTINCT rec, 0 AS id, 10 + rec % 20 AS first, 15 + rec % 20 AS last FROM frames),
n AS (SELECT s.rec, s.id, abs(v) AS size FROM s JOIN frames f ON f.rec = s.rec AND (k BETWEEN greatest(0, first - 12) AND first - 1 OR k BETWEEN last + 1 AND last + 12)),
m AS (SELECT rec, id, max(size) AS loud, min(size) AS low FROM n GROUP BY 1, 2), q AS (SELECT n.rec, n.id, size, row_number() OVER (PARTITION BY n.rec, n.id ORDER BY size) - 1 AS nth, count(*) OVER (PARTITION BY n.rec, n.id) AS c
FROM n JOIN m USING (rec, id) WHERE 2 * size <= loud)
SELECT m.rec, m.id, coalesce(max(size) FILTER (WHERE nth = CAST(floor(c * CAST(0.3 AS DOUBLE)) AS BIGINT)), any_value(low)) AS floor FROM m LEFT JOIN q USING (rec, id) GROUP BY 1, 2"""
)
def local_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir)
    spans = frames.select("rec").distinct().select("rec", F.lit(0).alias("id"), (10 + F.col("rec") % 20).alias("first"), (15 + F.col("rec") % 20).alias("last"))
    return ops.local_floor(frames, spans, 12)


@query(
    f"""WITH {FRAMES}, {LEVELS}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY win DESC) AS nth FROM levels)
SELECT rec, quantile_cont(CAST(energy AS DOUBLE), 0.75) AS body, quantile_cont(CAST(energy AS DOUBLE), 0.5) FILTER (WHERE nth <= 3) AS tail FROM n GROUP BY rec HAVING count(*) >= 4"""
)
def tail_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tail_levels(_levels(spark, sf_dir), 3, least=4, share=0.75)


@query(
    f"""WITH {FRAMES}, {LEVELS}, s AS (SELECT rec, {INDEX.format(c="energy", q=0.1)} AS floor, max(energy) AS peak, max(win) AS last_win FROM levels GROUP BY rec HAVING count(*) >= 3),
q AS (SELECT l.rec, win, energy, last_win, win - row_number() OVER (PARTITION BY l.rec ORDER BY win) AS run FROM levels l JOIN s USING (rec) WHERE energy < 9 * greatest(floor, 1) AND 10 * energy < 4 * peak),
m AS (SELECT rec, run, quantile_cont(CAST(energy AS DOUBLE), 0.5) AS middle FROM q GROUP BY rec, run, last_win HAVING count(*) >= 2 AND min(win) > 0 AND max(win) < last_win)
SELECT rec, max(middle) AS worst FROM m GROUP BY rec"""
)
def pause_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    return ops.pause_levels(levels, fr.quiet_runs(levels), 2)


@query(
    f"""WITH {FRAMES}, {LEVELS}, p AS (SELECT DISTINCT rec, 0 AS id, rec % 8 AS at_win FROM levels)
SELECT p.rec, p.id, arg_min(win, energy * 1000 + win) AS win, min(energy) AS energy FROM p JOIN levels l ON l.rec = p.rec AND abs(win - at_win) <= 2 GROUP BY 1, 2"""
)
def quietest_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    return ops.quietest_near(levels, levels.select("rec").distinct().select("rec", F.lit(0).alias("id"), (F.col("rec") % 8).alias("at")), 2)


@query(
    f"""WITH {FRAMES}, {LEVELS}, m AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY energy, win) AS nth, count(*) OVER (PARTITION BY rec) AS n FROM levels),
d AS (SELECT *, max(energy) FILTER (WHERE nth = n // 2 + 1) OVER (PARTITION BY rec) AS middle FROM m)
SELECT rec, win AS id, energy AS level, middle FROM d WHERE n <= 2 OR middle <= 0 OR energy * 2 >= middle AND energy <= 2 * middle"""
)
def tone_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.donors(_levels(spark, sf_dir).select("rec", F.col("win").alias("id"), F.col("energy").alias("level")))


@query(
    f"""WITH {SENTENCES}, p AS (SELECT rec, text, regexp_matches(rtrim(text), '[.!]$') AS ends, CASE WHEN ord % 7 <> 3 THEN CAST((rec * 31 + ord * 17) % 41 - 20 AS DOUBLE) END AS slope, CAST((rec + ord) % 13 AS DOUBLE) AS spread FROM sent)
SELECT rec, count(*) AS phrases, count(*) FILTER (WHERE ends AND slope IS NOT NULL) AS statements, quantile_cont(spread, 0.5) AS median_spread,
quantile_cont(slope, 0.5) FILTER (WHERE ends) AS statement_slope, quantile_cont(slope, 0.5) FILTER (WHERE NOT ends) AS other_slope,
round(100 * count(*) FILTER (WHERE ends AND slope > 1) / greatest(1, count(*) FILTER (WHERE ends AND slope IS NOT NULL)), 3) AS rising_percent FROM p GROUP BY rec"""
)
def phrase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.sentences(spark, sf_dir)
    slope = F.when(F.col("ord") % 7 != 3, ((F.col("rec") * 31 + F.col("ord") * 17) % 41 - 20).cast("double"))
    return ops.summary(rows.select("rec", "text", slope.alias("slope"), ((F.col("rec") + F.col("ord")) % 13).cast("double").alias("spread")), "rec", 1.0)


CLIPS = TAKES + ", clips AS (SELECT rec, kind AS source, id, 1000 + score % 9000 AS ms, 100 + score % 90 AS pace, id % 9 AS clicks FROM takes WHERE score IS NOT NULL)"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("score")
    return fx.takes(spark, sf_dir).where("score IS NOT NULL").select("rec", F.col("kind").alias("source"), "id", (1000 + score % 9000).alias("ms"), (100 + score % 90).alias("pace"), (F.col("id") % 9).alias("clicks"))


@query(
    f"""WITH {CLIPS} SELECT rec, count(*) AS clips, CAST(sum(ms) AS BIGINT) AS ms, round(avg(pace), 3) AS pace, round(avg(clicks), 3) AS clicks, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM clips WHERE clicks <= 6 AND abs(pace - 145) <= 30 AND ms >= 1500 GROUP BY rec"""
)
def chosen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chosen_summary(ops.usable(_clips(spark, sf_dir), 6, 145, 30, 1500), "rec")


@query(f"WITH {CLIPS} SELECT rec, id, round(clicks * 60000 / ms, 3) AS per_minute FROM clips")
def click_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("rec", "id", ops.clicks_per_minute(F.col("clicks"), F.col("ms")).alias("per_minute"))


READINGS = SPANS + ", found AS (SELECT rec, id % 500 AS unit, a, a + id % 20000 AS b, id % 11 AS matched, id % 13 AS wanted, id % 6 = 0 AS stumbled FROM spans)"
FIRST = """first_ AS (SELECT rec, unit, a, b FROM found WHERE wanted > 0 AND matched >= 0.65 * wanted AND NOT stumbled AND b - a BETWEEN 1200 AND 16000 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY rec, a, b) = 1)"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("id")
    return fx.spans(spark, sf_dir).select("rec", (id_ % 500).alias("unit"), "a", (F.col("a") + id_ % 20000).alias("b"), (id_ % 11).alias("matched"), (id_ % 13).alias("wanted"), (id_ % 6 == 0).alias("stumbled"))


@query(f"WITH {READINGS}, {FIRST} SELECT rec, unit, a, b FROM first_")
def first_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_readings(_readings(spark, sf_dir)).select("rec", "unit", "a", "b")


@query(
    f"""WITH {READINGS}, {FIRST}, k AS (SELECT rec, count(*) AS kept FROM first_ GROUP BY rec)
SELECT f.rec, coalesce(any_value(kept), 0) AS kept, count(*) FILTER (WHERE stumbled) AS stumbled, CAST(sum(matched) AS BIGINT) AS heard FROM found f LEFT JOIN k ON k.rec = f.rec GROUP BY f.rec"""
)
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _readings(spark, sf_dir)
    return ops.session_report(found, ops.first_readings(found))


@query(
    f"""WITH {FRAMES}, {PEAKS}, x AS (SELECT rec, unnest(range(40)) AS x FROM (SELECT DISTINCT rec FROM frames)),
e AS (SELECT rec, x, (250 * 40 + x * 500) * 16 AS lo, (250 * 40 + (x + 1) * 500) * 16 AS hi FROM x)
SELECT e.rec, x, max(peak) AS peak FROM e JOIN peaks p ON p.rec = e.rec AND bucket >= lo // 40000 AND bucket < greatest(lo // 40000 + 1, least(16, -(-hi // 40000))) GROUP BY 1, 2"""
)
def strip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle half of each recording's 16 peaks on 40 pixels."""
    return ops.strip(fr.peaks(fx.frames(spark, sf_dir)), 16, (250, 750), 40)


@query(
    f"""WITH {FRAMES}, {LEVELS}, c AS (SELECT rec, win * 70 + rec % 30 * (win % 3) AS t, energy AS v FROM levels), e AS (SELECT rec, min(t) AS low, max(t) AS high FROM c GROUP BY rec HAVING max(t) > min(t)),
g AS (SELECT rec, i, low + i * ((high - low) / 23) AS t FROM (SELECT rec, low, high, unnest(range(24)) AS i FROM e)),
s AS (SELECT rec, t, v, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY rec ORDER BY t))
SELECT g.rec, i, round(CASE WHEN i = 23 THEN (SELECT arg_max(v, t) FROM c WHERE c.rec = g.rec) ELSE v + (g.t - s.t) / (t2 - s.t) * (v2 - v) END, 1) AS v FROM g JOIN s ON s.rec = g.rec AND CASE WHEN i = 23 THEN t2 IS NULL ELSE s.t <= g.t AND g.t < t2 END"""
)
def pitch_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window energies as curves over uneven times, at 24 even ones."""
    levels = _levels(spark, sf_dir)
    points = levels.select("rec", (F.col("win") * 70 + F.col("rec") % 30 * (F.col("win") % 3)).alias("at"), F.col("energy").alias("v"))
    return ops.curve(points).select("rec", "i", F.round("v", 1).alias("v"))


FIXED = "fixed(nth, wrong, right_) AS (VALUES (1, 'Line', 'Row'), (2, '7', 'seven'), (3, 'again', 'anew'), (4, 'seven', '7'), (5, 'absent', 'none'))"


@query(
    f"""WITH RECURSIVE {SCRIPTED}, {FIXED}, walk AS (SELECT rec, id, say AS t, 0 AS nth, 0 AS n FROM scripted
UNION ALL SELECT rec, id, regexp_replace(t, '\\b' || wrong || '\\b', right_), f.nth, n + CASE WHEN regexp_matches(t, '\\b' || wrong || '\\b') THEN 1 ELSE 0 END FROM walk w JOIN fixed f ON f.nth = w.nth + 1)
SELECT rec, id, t AS text, CAST(n AS BIGINT) AS applied FROM walk WHERE nth = 5"""
)
def texts_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fixes of every line, of which one finds what another left."""
    lines = fx.scripted(fx.lines(fx.spans(spark, sf_dir)))
    fixes = F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(w).alias("wrong"), F.lit(r).alias("right")) for n, w, r in [(1, "Line", "Row"), (2, "7", "seven"), (3, "again", "anew"), (4, "seven", "7"), (5, "absent", "none")]])
    listed = lines.select("rec", "id", F.explode(fixes).alias("f")).select("rec", "id", "f.*")
    return ops.corrected(lines.select("rec", "id", F.col("say").alias("text")), listed)


@query(
    f"""WITH {FRAMES}, s AS (SELECT rec, abs(v) AS m, abs(v - lag(v) OVER (PARTITION BY rec ORDER BY k)) AS step FROM frames)
SELECT rec, count(*) AS frames, count(*) FILTER (WHERE m >= 20 AND step > 145) AS torn, round(100 * count(*) FILTER (WHERE m >= 20 AND step > 145) / count(*), 3) AS percent FROM s GROUP BY rec"""
)
def torn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.frames(spark, sf_dir).withColumn("step", F.abs(F.col("v") - F.lag("v").over(fr._order())))
    return ops.torn(rows.select("rec", F.abs("v").alias("motion"), "step"), 20, 145)


@query(f'WITH {LINES} SELECT rec, greatest(max(start) + 3000000, max("end")) AS "end" FROM lines GROUP BY rec')
def timeline_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.lines(fx.spans(spark, sf_dir))
    return ops.timeline_end(lines.groupBy("rec").agg((F.max("start") + 3_000_000).alias("duration")), lines.select("rec", F.col("end").alias("until")))


@query(f"WITH {SCRIPTED} SELECT rec, id, original, say FROM scripted WHERE rec <> 7 AND NOT dropped AND NOT locked AND {squash('say')} <> {squash('original')}")
def example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.examples_of(fx.scripted(fx.lines(fx.spans(spark, sf_dir))), 7)


@query(f"WITH {SCRIPTED} SELECT id, 'New ' || id AS after FROM scripted WHERE id % 3 <> 0 AND id % 4 <> 1 AND (id % 5 <> 0 OR say = original)")
def safe_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.scripted(fx.lines(fx.spans(spark, sf_dir))).withColumn("edited", F.col("id") % 4 == 1)
    made = lines.select("id", F.when(F.col("id") % 3 == 0, "drop").otherwise("polish").alias("kind"), F.when(F.col("id") % 5 == 0, F.col("original")).otherwise(F.col("say")).alias("before"), F.concat(F.lit("New "), F.col("id").cast("string")).alias("after"))
    return ops.safe_suggestions(made, lines)
