"""Queries over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import units
from timeloom.operators import intervals, plan
from timeloom.sources import fixtures as fx

from .registry import query
from .views import LINES, SCRIPTED, SPANS, WORDS, union

CUTS = "cuts AS (SELECT rec, a, b FROM spans WHERE kind = 'purchase')"


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return fx.spans(spark, sf_dir).where(F.col("kind") == kind)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.spans(spark, sf_dir).where("kind <> 'purchase'").select("rec", "id", F.col("a").alias("t"))


@query(f"WITH {SPANS}, {union('spans')} SELECT * FROM u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(fx.spans(spark, sf_dir))


@query(f"""WITH {SPANS}, ext AS (SELECT rec, min(a) - 1000 AS low, max(b) + 1000 AS high FROM spans GROUP BY rec), {union('spans')},
holes AS (SELECT rec, lag(b) OVER (PARTITION BY rec ORDER BY a) AS a, a AS b FROM u
          UNION ALL SELECT e.rec, low, min(a) FROM ext e JOIN u USING (rec) GROUP BY e.rec, low
          UNION ALL SELECT e.rec, max(b), high FROM ext e JOIN u USING (rec) GROUP BY e.rec, high)
SELECT rec, a, b FROM holes WHERE a IS NOT NULL AND b > a""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fx.spans(spark, sf_dir)
    extents = spans.groupBy("rec").agg((F.min("a") - 1000).alias("low"), (F.max("b") + 1000).alias("high"))
    return intervals.complement(spans, extents)


@query(f"""WITH {SPANS}, {CUTS}, {union('cuts', 'c')}, left_ AS (SELECT rec, id, a, b FROM spans WHERE kind <> 'purchase'),
inner_ AS (SELECT l.rec, l.id, l.a, l.b, c.a AS c, c.b AS d FROM left_ l JOIN c ON c.rec = l.rec AND c.a < l.b AND c.b > l.a),
edges AS (SELECT rec, id, a, coalesce(min(c), any_value(b)) AS b FROM inner_ GROUP BY rec, id, a
          UNION ALL SELECT rec, id, d, coalesce(lead(c) OVER (PARTITION BY rec, id ORDER BY c), b) FROM inner_
          UNION ALL SELECT rec, id, a, b FROM left_ l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rec = l.rec AND c.a < l.b AND c.b > l.a))
SELECT rec, id, a, b FROM edges WHERE b - a > 20""")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = fx.spans(spark, sf_dir).where("kind <> 'purchase'").select("rec", "id", "a", "b")
    return intervals.subtract(rest, _kind(spark, sf_dir, "purchase"), least=20)


@query(f"WITH {SPANS}, {CUTS} SELECT rec, id, a AS t FROM spans s WHERE kind <> 'purchase' AND EXISTS (SELECT 1 FROM cuts c WHERE c.rec = s.rec AND s.a BETWEEN c.a AND c.b)")
def points_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.points_in(_points(spark, sf_dir), _kind(spark, sf_dir, "purchase"))


@query(f"WITH {SPANS}, {CUTS} SELECT rec, id, a AS t FROM spans s WHERE kind <> 'purchase' AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.rec = s.rec AND s.a BETWEEN c.a AND c.b)")
def points_outside_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.points_in(_points(spark, sf_dir), _kind(spark, sf_dir, "purchase"), keep=False)


@query(f"""WITH {SPANS} SELECT x.rec, x.id, y.id AS other, CASE WHEN x.a >= y.a AND x.b <= y.b THEN 'inside' ELSE 'straddles' END AS relation
FROM spans x JOIN spans y ON x.rec = y.rec AND x.a < y.b AND y.a < x.b WHERE x.kind <> 'purchase' AND y.kind = 'purchase'""")
def overlap_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(fx.spans(spark, sf_dir).where("kind <> 'purchase'"), _kind(spark, sf_dir, "purchase"))


MARKS = "marks AS (SELECT rec, id AS mark, a AS instant FROM spans WHERE kind = 'error'), pts AS (SELECT rec, id, a AS t FROM spans WHERE kind <> 'error')"


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = fx.spans(spark, sf_dir)
    return spans.where("kind <> 'error'").select("rec", "id", F.col("a").alias("t")), spans.where("kind = 'error'").select("rec", F.col("id").alias("mark"), F.col("a").alias("at"))


@query(f"""WITH {SPANS}, {MARKS} SELECT p.rec, p.id, arg_max(mark, (-abs(t - instant), instant, mark)) AS mark, min(abs(t - instant)) AS away
FROM pts p JOIN marks m ON m.rec = p.rec AND abs(t - instant) <= 3600000 GROUP BY p.rec, p.id""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.nearest(*_marks(spark, sf_dir), reach=3_600_000)


@query(f"""WITH {SPANS}, {MARKS} SELECT rec, id, (SELECT max(instant) FROM marks m WHERE m.rec = p.rec AND instant <= t) AS previous, (SELECT min(instant) FROM marks m WHERE m.rec = p.rec AND instant > t) AS following FROM pts p""")
def surrounding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.around(*_marks(spark, sf_dir))


PLACED = "placed AS (SELECT rec, ord, id, start - min(start) OVER (PARTITION BY rec) AS a, \"end\" - min(start) OVER (PARTITION BY rec) AS b, id % 7 = 0 AS hold FROM lines)"
TILES = """
p AS (SELECT *, coalesce(max(b) OVER (PARTITION BY rec ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e, coalesce(lag(hold) OVER (PARTITION BY rec ORDER BY ord), true) AS held FROM placed),
q AS (SELECT *, NOT held AND a - e >= 800 AS glide, greatest(e, a - 280) AS cut FROM p),
flat AS (SELECT rec, ord, 1 AS nth, e AS a, cut AS b, 3 AS speed FROM q WHERE glide AND cut - e > 10
         UNION ALL SELECT rec, ord, 2, cut, a, 1 FROM q WHERE glide AND a > cut
         UNION ALL SELECT rec, ord, 3, e, a, 1 FROM q WHERE NOT glide AND a - e > 10
         UNION ALL SELECT rec, ord, 4, greatest(a, e), greatest(b, a, e), 1 FROM q WHERE b > greatest(a, e)),
runs AS (SELECT *, CASE WHEN lag(speed) OVER o = speed AND lag(b) OVER o = a THEN 0 ELSE 1 END AS fresh FROM flat WINDOW o AS (PARTITION BY rec ORDER BY a, b, ord, nth)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY a, b, ord, nth) AS run FROM runs),
tiles AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY min(a)) - 1 AS ord, min(a) AS a, max(b) AS b, any_value(speed) AS speed FROM isl GROUP BY rec, run HAVING max(b) - min(a) > 20)
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.lines(fx.spans(spark, sf_dir))
    first = lines.groupBy("rec").agg(F.min("start").alias("zero"))
    return lines.join(first, "rec").select("rec", "ord", "id", (F.col("start") - F.col("zero")).alias("a"), (F.col("end") - F.col("zero")).alias("b"), (F.col("id") % 7 == 0).alias("hold"))


@query(f"WITH {LINES}, {PLACED}, {TILES} SELECT * FROM tiles")
def speed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.tiles(_placed(spark, sf_dir))


REMAP = """
sized AS (SELECT *, (b - a) * 6 // speed AS len FROM tiles),
begun AS (SELECT rec, a, b, speed, sum(len) OVER (PARTITION BY rec ORDER BY a ROWS UNBOUNDED PRECEDING) - len AS done FROM sized)
"""


@query(f"""WITH {LINES}, {PLACED}, {TILES}, {REMAP}, pts AS (SELECT rec, id, a + 137 AS t FROM placed)
SELECT p.rec, p.id, CAST(coalesce(done + (least(t, b.b) - b.a) * 6 // speed, 0) AS BIGINT) AS out FROM pts p ASOF LEFT JOIN begun b ON b.rec = p.rec AND p.t >= b.a""")
def time_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    return intervals.remap(placed.select("rec", "id", (F.col("a") + 137).alias("t")), intervals.tiles(placed))


def _stamp(ms: str) -> str:
    part = lambda value, n: f"lpad(CAST({value} AS VARCHAR), {n}, '0')"
    return f"{part(f'({ms}) // 3600000', 2)} || ':' || {part(f'({ms}) // 60000 % 60', 2)} || ':' || {part(f'({ms}) // 1000 % 60', 2)} || '.' || {part(f'({ms}) % 1000', 3)}"


# rows are filled word by word
@query(
    f"""WITH RECURSIVE {WORDS}, s AS MATERIALIZED (SELECT rec, turn, w, row_number() OVER (PARTITION BY rec, turn ORDER BY idx) AS pos FROM words),
walk AS (SELECT rec, turn, pos, 1 AS line, length(w) AS size FROM s WHERE pos = 1
         UNION ALL SELECT s.rec, s.turn, s.pos, CASE WHEN size + 1 + length(s.w) <= 42 THEN line ELSE line + 1 END, CASE WHEN size + 1 + length(s.w) <= 42 THEN size + 1 + length(s.w) ELSE length(s.w) END
         FROM walk k JOIN s ON s.rec = k.rec AND s.turn = k.turn AND s.pos = k.pos + 1),
filled AS (SELECT rec, turn, line, string_agg(w, ' ' ORDER BY pos) AS text, count(*) AS n FROM walk JOIN s USING (rec, turn, pos) GROUP BY rec, turn, line),
parts AS (SELECT rec, turn, (line - 1) // 2 AS part, string_agg(text, chr(10) ORDER BY line) AS text, CAST(sum(n) AS BIGINT) AS n FROM filled GROUP BY rec, turn, (line - 1) // 2),
ext AS (SELECT rec, turn, min(start_ms) AS a, max(end_ms) AS b FROM words GROUP BY rec, turn),
c AS (SELECT rec, turn, part, text, a, b, n, greatest(100, b - a) AS span, CAST(sum(n) OVER (PARTITION BY rec, turn) AS BIGINT) AS total, CAST(sum(n) OVER (PARTITION BY rec, turn ORDER BY part) - n AS BIGINT) AS done FROM parts JOIN ext USING (rec, turn)),
d AS (SELECT rec, turn AS ord, part, text, a + CAST(floor(span * done / total) AS BIGINT) AS c, least(a + CAST(floor(span * (done + n) / total) AS BIGINT), b) AS d FROM c),
e AS (SELECT *, least(d, coalesce(lead(c) OVER (PARTITION BY rec ORDER BY c, ord, part), d)) AS b FROM d)
SELECT rec, CAST(ord AS BIGINT) AS ord, CAST(part AS BIGINT) AS part, {_stamp("c")} AS begins, {_stamp("b")} AS ends, text FROM e"""
)
def caption_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of each turn."""
    words = fx.words(spark, sf_dir)
    turns = words.groupBy("rec", F.col("turn").cast("long").alias("ord")).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda x: x["w"]), " ").alias("text"))
    return plan.cues(turns).select("rec", "ord", "part", units.stamp(F.col("a")).alias("begins"), units.stamp(F.col("b")).alias("ends"), "text")


@query(f"""WITH RECURSIVE {LINES}, live AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY ord) AS nth FROM lines WHERE NOT dropped),
walk AS (SELECT rec, nth, id, CASE WHEN locked THEN start ELSE greatest(start, 120) END AS "at", CASE WHEN locked THEN "end" ELSE greatest(start, 120) + len + hold END AS edge FROM live WHERE nth = 1
         UNION ALL SELECT l.rec, l.nth, l.id, CASE WHEN l.locked THEN l.start ELSE greatest(l.start, w.edge + 120) END, CASE WHEN l.locked THEN l."end" ELSE greatest(l.start, w.edge + 120) + l.len + l.hold END
         FROM walk w JOIN live l ON l.rec = w.rec AND l.nth = w.nth + 1)
SELECT rec, id, "at" FROM walk""")
def room_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.cascade(fx.lines(fx.spans(spark, sf_dir))).select("rec", "id", "at")


@query(f"""WITH {SPANS}, ext AS (SELECT rec, min(a) - 7200000 AS low, max(b) + 7200000 AS high FROM spans GROUP BY rec), {union('spans')},
holes AS (SELECT rec, lag(b) OVER (PARTITION BY rec ORDER BY a) AS a, a AS b FROM u
          UNION ALL SELECT e.rec, low, min(a) FROM ext e JOIN u USING (rec) GROUP BY e.rec, low UNION ALL SELECT e.rec, max(b), high FROM ext e JOIN u USING (rec) GROUP BY e.rec, high)
SELECT s.rec, s.id, h.a AS gap_a, h.b AS gap_b FROM spans s JOIN holes h ON h.rec = s.rec AND s.a + 5000000 >= h.a AND s.a + 5000000 < h.b""")
def free_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fx.spans(spark, sf_dir)
    extents = spans.groupBy("rec").agg((F.min("a") - 7_200_000).alias("low"), (F.max("b") + 7_200_000).alias("high"))
    return intervals.free_gap(spans.select("rec", "id", (F.col("a") + 5_000_000).alias("t")), spans, extents)


@query(
    f"""WITH RECURSIVE {SCRIPTED}, n AS (SELECT *, start + "offset" AS asked, coalesce(lead(start + "offset") OVER (PARTITION BY rec ORDER BY ord) - 20, "end" + len) AS high FROM scripted),
p AS (SELECT rec, ord, CASE WHEN dropped OR locked THEN start ELSE greatest(0, least(asked, high)) END AS place, CASE WHEN dropped THEN start WHEN locked THEN "end" ELSE greatest(0, least(asked, high)) + len END AS until FROM n WHERE ord = 0
      UNION ALL SELECT n.rec, n.ord, CASE WHEN dropped OR locked THEN start ELSE greatest(until + 20, least(asked, high)) END, CASE WHEN dropped THEN start WHEN locked THEN "end" ELSE greatest(until + 20, least(asked, high)) + len END
      FROM p JOIN n ON n.rec = p.rec AND n.ord = p.ord + 1)
SELECT rec, ord, CAST(place AS BIGINT) AS "at", CAST(until AS BIGINT) AS until FROM p"""
)
def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place depends on the one before it."""
    return plan.place(fx.scripted(fx.lines(fx.spans(spark, sf_dir))))
