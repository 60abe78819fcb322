"""Queries over joins of ranges, events of a signal, steady windows, row profiles, phrases and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import seams as ops
from timeloom.sources import fixtures as fx

from .registry import query
from .views import FRAMES, LINES

REACH, PER_FRAME, FLOOR, APART = 4, 10, -3400, 900


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes as levels in hundredths of a decibel."""
    return fx.frames(spark, sf_dir).select("rec", "k", (20 * F.abs("v") - 6000).alias("level"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ranges over the 64 frames of each recording, of different lengths and gaps."""
    rec = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("ord"))
    a = 13 * F.col("ord") + (F.col("rec") + F.col("ord")) % 3
    length = F.when((F.col("rec") + F.col("ord")) % 7 == 0, 3).otherwise(9 + (7 * F.col("rec") + F.col("ord")) % 3)
    return rec.select("rec", "ord", a.alias("a"), F.least(F.lit(63), a + length).alias("b"))


def _between(k: str, centre: str, low: str, high: str) -> str:
    clamp = f"greatest(0, least({centre}, l.frames - 1))"
    return f"{k} BETWEEN CASE WHEN {high} > {low} THEN {low} ELSE {clamp} END AND CASE WHEN {high} > {low} THEN {high} - 1 ELSE {clamp} END"


_LOW_OUT, _HIGH_OUT = f"greatest(0, r.b - {REACH}, r.b - (r.b - w.a) * 4 // 10)", f"least(l.frames - 1, r.b + {REACH})"
_LOW_IN, _HIGH_IN = f"greatest(0, n.a - {REACH})", f"least(l.frames - 1, n.a + {REACH}, n.a + (n.b - n.a) * 4 // 10)"
_MOVED = "CASE WHEN {high} > {low} THEN abs({k} - {centre}) ELSE 0 END"

# one junction after the other, as each moves where the next range begins
_WALK = f"""{FRAMES},
lv AS MATERIALIZED (SELECT rec, k, 20 * abs(v) - 6000 AS level, max(k) OVER (PARTITION BY rec) + 1 AS frames FROM frames),
ranges AS MATERIALIZED (
    SELECT vec_id AS rec, ord, 13 * ord + (vec_id + ord) % 3 AS a, least(63, 13 * ord + (vec_id + ord) % 3 + CASE WHEN (vec_id + ord) % 7 = 0 THEN 3 ELSE 9 + (7 * vec_id + ord) % 3 END) AS b
    FROM embeddings, unnest(range(5)) AS t(ord)),
walk AS (
    SELECT rec, 0::BIGINT AS nth, a, NULL::BIGINT AS leave, NULL::BIGINT AS enter, false AS kept FROM ranges WHERE ord = 0
    UNION ALL
    SELECT rec, nth + 1, CASE WHEN greatest(lo, li) <= {FLOOR} AND abs(lo - li) <= {APART} THEN i ELSE next_a END, o, i, coalesce(greatest(lo, li) <= {FLOOR} AND abs(lo - li) <= {APART}, false) FROM (
        SELECT w.rec, w.nth, n.a AS next_a, l.k AS o, m.k AS i, l.level AS lo, m.level AS li,
               4 * abs(l.level - m.level) + l.level + m.level + {4 * PER_FRAME} * ({_MOVED.format(high=_HIGH_OUT, low=_LOW_OUT, k="l.k", centre="r.b")} + {_MOVED.format(high=_HIGH_IN, low=_LOW_IN, k="m.k", centre="n.a")}) AS cost
        FROM walk w JOIN ranges r ON r.rec = w.rec AND r.ord = w.nth JOIN ranges n ON n.rec = w.rec AND n.ord = w.nth + 1 JOIN lv l ON l.rec = w.rec JOIN lv m ON m.rec = w.rec AND m.k > l.k
        WHERE {_between("l.k", "r.b", _LOW_OUT, _HIGH_OUT)} AND {_between("m.k", "n.a", _LOW_IN, _HIGH_IN)})
    QUALIFY row_number() OVER (PARTITION BY rec, nth ORDER BY cost, o, i) = 1),
chosen AS (SELECT rec, nth - 1 AS ord, leave, enter, kept FROM walk WHERE nth > 0)"""


@query(f"WITH RECURSIVE {_WALK} SELECT * FROM chosen")
def junction_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.junctions(_levels(spark, sf_dir), _ranges(spark, sf_dir), REACH, PER_FRAME, FLOOR, APART)


@query(
    f"""WITH RECURSIVE {_WALK},
moved AS (SELECT r.rec, r.ord, coalesce(lag(coalesce(kept, false)) OVER w, true) AS fresh, CASE WHEN lag(kept) OVER w THEN lag(enter) OVER w ELSE a END AS a, CASE WHEN kept THEN leave ELSE b END AS b FROM ranges r LEFT JOIN chosen USING (rec, ord) WINDOW w AS (PARTITION BY r.rec ORDER BY r.ord)),
runs AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY rec ORDER BY ord) AS run FROM moved),
whole AS (SELECT rec, run, arg_min(a, ord) AS a, arg_max(b, ord) AS b FROM runs GROUP BY rec, run),
apart AS (SELECT rec, greatest(a, lag(b) OVER (PARTITION BY rec ORDER BY run)) AS a, b FROM whole)
SELECT rec, a, b FROM apart WHERE b - a > 2"""
)
def refined_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _ranges(spark, sf_dir)
    return ops.refined(ranges, ops.junctions(_levels(spark, sf_dir), ranges, REACH, PER_FRAME, FLOOR, APART), 2)


@query(
    f"""WITH RECURSIVE {FRAMES}, s AS (SELECT rec, k, abs(v) AS level, coalesce(abs(v - lag(v) OVER (PARTITION BY rec ORDER BY k)), 0) AS step FROM frames),
m AS (SELECT rec, k, step, quantile_cont(step, 0.5) OVER w AS around, quantile_cont(level, 0.5) OVER w AS context, max(level) OVER (PARTITION BY rec) AS top, max(k) OVER (PARTITION BY rec) AS last FROM s WINDOW w AS (PARTITION BY rec ORDER BY k ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING)),
e AS MATERIALIZED (SELECT rec, k FROM m WHERE step > 1 * around AND context < 0.9 * top AND k >= 8 AND k <= last - 8),
walk AS (SELECT rec, min(k) AS k FROM e GROUP BY rec UNION ALL SELECT w.rec, e.k FROM walk w JOIN e ON e.rec = w.rec AND e.k > w.k + 5 QUALIFY row_number() OVER (PARTITION BY w.rec ORDER BY e.k) = 1)
SELECT rec, k FROM walk"""
)
def clicks_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clicks(fx.frames(spark, sf_dir), radius=8, factor=1, quiet=0.9, apart=5)


@query("""WITH p AS (SELECT vec_id // 16 AS rec, vec_id AS ord, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS r FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT rec, ord, r, lag(r) OVER (PARTITION BY rec ORDER BY ord) AS q FROM p), d AS (SELECT rec, ord, list_transform(list_zip(r, q), lambda z: abs(z[1] - z[2])) AS d FROM b WHERE q IS NOT NULL),
u AS (SELECT rec, ord, generate_subscripts(d, 1) AS i, unnest(d) AS x, len(d) AS n, list_sum(d) AS total, list_max(d) AS most FROM d),
c AS (SELECT *, sum(x) OVER (PARTITION BY rec, ord ORDER BY i) AS head FROM u), g AS (SELECT rec, ord, i, n, total, most, abs(head / i - (total - head) / (n - i)) AS gap FROM c WHERE i >= 8 AND i < n - 8)
SELECT rec, ord, CAST(i AS INTEGER) AS at, gap, most >= 30 AND gap / greatest(total / n, 0.5) > 0.3 AS torn FROM g QUALIFY row_number() OVER (PARTITION BY rec, ord ORDER BY gap DESC, i) = 1""")
def row_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pictures of 64 rows, sixteen to a recording."""
    rows = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000))
    pictures = fx.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.floor(F.col("vec_id") / 16).alias("rec"), F.col("vec_id").alias("ord"), rows.alias("rows"))
    return ops.row_steps(pictures, step=0.3)


_STEADY = f"""{FRAMES}, p AS (SELECT rec, k // 4 AS pos, sum(v * v) AS energy, max(abs(v)) AS peak, count(*) AS n FROM frames GROUP BY 1, 2),
t AS (SELECT rec, sum(energy) AS total, sum(n) AS frames FROM p GROUP BY rec), h AS (SELECT rec, energy, peak, q FROM p, unnest(range(greatest(0, pos - 2) // 2, pos // 2 + 1)) AS s(q) WHERE n = 4 AND 2 * q + 3 >= pos),
w AS (SELECT rec, q, sum(energy) AS energy, min(energy) AS low, max(energy) AS high, max(peak) AS peak FROM h GROUP BY rec, q HAVING count(*) = 4),
steady AS (SELECT rec, q * 8 AS start, CAST(energy AS BIGINT) AS energy FROM w JOIN t USING (rec)
    WHERE energy > greatest(2.0 * 2.0 * 16, 0.3 * 0.3 * 16 * total / frames) AND low > 0 AND high <= 2.5 * 2.5 * low AND peak * peak * 16 <= 2.6 * 2.6 * energy)"""


@query(f"WITH {_STEADY} SELECT rec, start, energy FROM steady")
def steady_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.steady_windows(fx.frames(spark, sf_dir), part=4, wide=4, hop=2, swing=2.5, crest=2.6, silent=0.3)


@query(f"WITH {_STEADY} SELECT rec, start, energy FROM steady QUALIFY row_number() OVER (PARTITION BY rec ORDER BY energy, start) = least(count(*) OVER (PARTITION BY rec), floor(count(*) OVER (PARTITION BY rec) * 0.1) + 1)")
def room_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.room_tone(ops.steady_windows(fx.frames(spark, sf_dir), part=4, wide=4, hop=2, swing=2.5, crest=2.6, silent=0.3))


def _slope(value: str, some: str) -> str:
    n, x, y, xx, xy = (f"{a} FILTER ({some})" for a in ("count(*)", "sum(k)", f"sum({value})", "sum(k * k)", f"sum(k * {value})"))
    return f"CASE WHEN {n} >= 3 THEN CAST({n} * {xy} - {x} * {y} AS BIGINT) / CAST({n} * {xx} - {x} * {x} AS BIGINT) END"


@query(
    f"""WITH {FRAMES}, f AS (SELECT rec, k, CASE WHEN v % 5 <> 0 THEN v END AS pitch, abs(v) AS level FROM frames),
ph AS (SELECT vec_id AS rec, id, id * 19 + vec_id % 4 AS a, id * 19 + vec_id % 4 + 16 + (vec_id + id) % 9 AS b FROM embeddings, unnest(range(3)) AS t(id)),
r AS (SELECT ph.rec, id, a, b, k, pitch, level, max(k) FILTER (pitch IS NOT NULL) OVER (PARTITION BY ph.rec, id) AS last FROM ph JOIN f ON f.rec = ph.rec AND k BETWEEN a AND b),
c AS (SELECT *, pitch IS NOT NULL AND k >= last - 8 AS late, 3 * k >= 3 * a + 2 * (b - a) AS third, pitch IS NOT NULL AND k >= last - 5 AS ending, pitch IS NOT NULL AND k < last - 5 AND k >= last - 15 AS front FROM r)
SELECT rec, id, count(*) AS frames, count(pitch) AS voiced, quantile_cont(pitch, 0.5) AS median, quantile_cont(pitch, 0.75) - quantile_cont(pitch, 0.25) AS spread,
       {_slope("pitch", "late")} AS terminal_slope, {_slope("level", "third")} AS sustain,
       CASE WHEN count(pitch) >= 8 AND count(*) FILTER (ending) >= 3 AND count(*) FILTER (front) >= 3 THEN quantile_cont(pitch, 0.5) FILTER (ending) - quantile_cont(pitch, 0.5) FILTER (front) END AS terminal_step
FROM c GROUP BY rec, id HAVING count(*) >= 6 AND count(pitch) >= 5"""
)
def phrase_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir).select("rec", "k", F.when(F.col("v") % 5 != 0, F.col("v")).alias("pitch"), F.abs("v").alias("level"))
    phrases = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("id"))
    a = F.col("id") * 19 + F.col("rec") % 4
    phrases = phrases.select("rec", "id", a.alias("a"), (a + 16 + (F.col("rec") + F.col("id")) % 9).alias("b"))
    return ops.phrase_measures(frames, phrases, tail=8, step_tail=5, step_before=10, bucket=32)


def _cell(column: str) -> str:
    return f"coalesce('=' || CAST({column} AS VARCHAR), '-')"


@query(
    f"""WITH {LINES}, d0 AS (SELECT rec, ord AS pos, sha256(concat_ws(chr(31), {", ".join(_cell(c) for c in ('id', 'start', '"end"', 'len', 'hold'))})) AS digest FROM lines),
d1 AS (SELECT rec, pos // 16 AS pos, sha256(string_agg(pos || ':' || digest, ',' ORDER BY pos)) AS digest, count(*) AS n FROM d0 GROUP BY rec, pos // 16),
d2 AS (SELECT rec, pos // 16 AS pos, sha256(string_agg(pos || ':' || digest, ',' ORDER BY pos)) AS digest, sum(n) AS n FROM d1 GROUP BY rec, pos // 16)
SELECT rec, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(pos || ':' || digest, ',' ORDER BY pos)) AS fingerprint FROM d2 GROUP BY rec"""
)
def mix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recording's assembled lines depend on, as one digest."""
    return ops.fingerprint(fx.lines(fx.spans(spark, sf_dir)), ["rec"], "ord", ["id", "start", "end", "len", "hold"], width=16)
