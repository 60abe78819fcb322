"""Queries over numbered lines, snapshots, attempts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import lines as ops
from timeloom.operators import metrics, rank
from timeloom.sources import fixtures as fx

from .registry import query
from .views import CRC_TABLE, LINES, TAKES, crc


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.lines(fx.spans(spark, sf_dir))


@query(f"""WITH {LINES} SELECT rec, ord, id, CAST(floor(greatest(coalesce(lead(start) OVER (PARTITION BY rec ORDER BY ord), "end") - start, 0) * 3 / 1000) AS BIGINT) AS budget FROM lines""")
def word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.word_budget(_lines(spark, sf_dir)).select("rec", "ord", "id", "budget")


@query(f"""WITH {LINES} SELECT rec, id, over FROM (SELECT rec, id, "end" - lead(start) OVER (PARTITION BY rec ORDER BY ord) AS over FROM lines WHERE NOT dropped) WHERE over > 60""")
def line_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overlaps_next(_lines(spark, sf_dir))


@query(f"""WITH {LINES} SELECT rec, id, gap FROM (SELECT rec, id, lead(start) OVER o - max("end") OVER o AS gap FROM lines WHERE NOT dropped WINDOW o AS (PARTITION BY rec ORDER BY ord)) WHERE gap >= 800""")
def reclaimable_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reclaimable(_lines(spark, sf_dir))


@query(f"""WITH {LINES} SELECT rec, ord, id,
last_value(CASE WHEN NOT dropped THEN id END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_live,
first_value(CASE WHEN NOT dropped THEN id END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_live FROM lines""")
def live_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.live_neighbours(_lines(spark, sf_dir)).select("rec", "ord", "id", "prev_live", "next_live")


@query(f"WITH {LINES} SELECT rec, b AS batch, ord FROM lines, unnest(range(CAST(greatest(0, ceil((ord - 39) / 36)) AS BIGINT), ord // 36 + 1)) AS r(b)")
def line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batches(_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT rec, count(*) AS total, count(*) FILTER (dropped) AS dropped, count(*) FILTER (locked AND NOT dropped) AS locked, count(*) FILTER (NOT locked AND NOT dropped) AS open FROM lines GROUP BY rec")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_counts(_lines(spark, sf_dir))


RUNS = "runs AS (SELECT rec, ord // 3 AS run, id FROM lines WHERE ord % 6 < 3)"


@query(f"""WITH {LINES}, {RUNS} SELECT rec, run, count(*) >= 2 AND max(ord) - min(ord) + 1 = count(*) AND NOT bool_or(dropped) AND bool_or(locked) = bool_and(locked) AS mergeable FROM runs JOIN lines USING (rec, id) GROUP BY rec, run""")
def merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return ops.merge_check(lines, lines.where("ord % 6 < 3").select("rec", F.floor(F.col("ord") / 3).alias("run"), "id"))


@query(f"""WITH {LINES}, {RUNS}, fine AS (SELECT rec, run FROM runs JOIN lines USING (rec, id) GROUP BY rec, run HAVING count(*) >= 2 AND max(ord) - min(ord) + 1 = count(*) AND NOT bool_or(dropped) AND bool_or(locked) = bool_and(locked)),
members AS (SELECT l.*, run FROM runs JOIN fine USING (rec, run) JOIN lines l USING (rec, id))
SELECT rec, ord, id, start, "end", len FROM lines l WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.rec = l.rec AND m.id = l.id)
UNION ALL SELECT rec, min(ord), arg_min(id, ord), min(start), max("end"), CAST(sum(len) AS BIGINT) FROM members GROUP BY rec, run""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    merged, _ = ops.merge(lines, lines.where("ord % 6 < 3").select("rec", F.floor(F.col("ord") / 3).alias("run"), "id"))
    return merged.select("rec", "ord", "id", "start", "end", "len")


@query(f"""WITH {LINES}, sections AS (SELECT rec, a, b FROM spans WHERE kind = 'error')
SELECT rec, id, dropped OR EXISTS (SELECT 1 FROM sections s WHERE s.rec = l.rec AND s.a < l."end" AND l.start < s.b AND l.start >= s.a AND l."end" <= s.b) AS dropped,
       EXISTS (SELECT 1 FROM sections s WHERE s.rec = l.rec AND s.a < l."end" AND l.start < s.b AND NOT (l.start >= s.a AND l."end" <= s.b)) AS straddles FROM lines l""")
def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fx.spans(spark, sf_dir)
    return ops.cut(fx.lines(spans), spans.where("kind = 'error'").select("rec", "a", "b")).select("rec", "id", "dropped", "straddles")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    new = orders.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority")))
    return orders.where("o_orderkey % 19 <> 0"), new


SNAPSHOTS = """
old_ AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 19 <> 0),
new_ AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 17 <> 0)
"""


@query(f"""WITH {SNAPSHOTS}, j AS (SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, CASE WHEN x.o_orderkey IS NULL THEN 'added' WHEN y.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
x.s IS DISTINCT FROM y.s AS ds, x.p IS DISTINCT FROM y.p AS dp FROM old_ x FULL JOIN new_ y ON x.o_orderkey = y.o_orderkey)
SELECT o_orderkey, change, CASE WHEN change <> 'changed' THEN '' WHEN ds AND dp THEN 'o_orderstatus,o_orderpriority' WHEN ds THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS columns FROM j WHERE change <> 'changed' OR ds OR dp""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snapshot_diff(*_snapshots(spark, sf_dir), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status = F.create_map(F.lit("o_orderstatus"), F.lit("P"), F.lit("ignored"), F.lit("x"))
    both = F.map_concat(status, F.create_map(F.lit("o_orderpriority"), F.lit(None).cast("string")))
    patches = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, both).otherwise(status).alias("patch"))
    return ops.patch(orders, patches, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH stored AS (SELECT o_orderkey AS id, o_orderkey % 9 AS rev, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'draft' END AS state, o_orderpriority AS body FROM orders WHERE o_orderkey % 4 <> 0),
incoming AS (SELECT o_orderkey AS id, o_orderkey % 5 AS rev, CASE WHEN o_orderkey % 3 = 0 THEN 'building' ELSE 'draft' END AS state, o_orderstatus AS body FROM orders WHERE o_orderkey % 6 <> 0)
SELECT coalesce(x.id, y.id) AS id, CASE WHEN y.id IS NOT NULL THEN greatest(coalesce(x.rev, 0), y.rev) + 1 ELSE x.rev END AS rev,
       CASE WHEN y.id IS NOT NULL AND NOT coalesce(x.rev > y.rev AND y.state = 'building' AND x.state <> 'building', false) THEN y.state ELSE x.state END AS state, CASE WHEN y.id IS NOT NULL THEN y.body ELSE x.body END AS body
FROM stored x FULL JOIN incoming y ON x.id = y.id WHERE x.id IS NOT NULL OR y.rev = 0""")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = fx.table(spark, sf_dir, "orders")
    stored = orders.where(k % 4 != 0).select(k.alias("id"), (k % 9).alias("rev"), F.when(k % 2 == 0, "done").otherwise("draft").alias("state"), F.col("o_orderpriority").alias("body"))
    incoming = orders.where(k % 6 != 0).select(k.alias("id"), (k % 5).alias("rev"), F.when(k % 3 == 0, "building").otherwise("draft").alias("state"), F.col("o_orderstatus").alias("body"))
    return ops.upsert(stored, incoming)


CANDIDATES = f"""{TAKES}, cand AS (SELECT rec, kind, count(*) AS takes, count(*) FILTER (score % 4 = 0) AS wrong, min(score) AS low, max(score) AS high FROM takes GROUP BY 1, 2),
scored AS (SELECT *, 30 * takes + 25 * abs(low - 145) + CASE WHEN high = low THEN 300 ELSE high - low END AS score, wrong * 5 > takes AS gated FROM cand)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by user and type with whole-number figures, so that sums do not depend on their order."""
    rows = fx.takes(spark, sf_dir).groupBy("rec", "kind").agg(F.count(F.lit(1)).alias("takes"), F.count_if(F.col("score") % 4 == 0).alias("wrong"), F.min("score").alias("low"), F.max("score").alias("high"))
    spread = F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0)), F.lit(300))
    return rows.withColumn("score", 30 * F.col("takes") + 25 * F.abs(F.col("low") - 145) + spread).withColumn("gated", rank.gated(F.col("wrong"), F.col("takes")))


@query(f"WITH {CANDIDATES} SELECT rec, kind, takes, wrong, score, gated, row_number() OVER (PARTITION BY rec ORDER BY gated, score, kind) AS place FROM scored")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.ranked(_candidates(spark, sf_dir), ["rec"], "gated", "score", "kind").select("rec", "kind", "takes", "wrong", "score", "gated", "place")


@query(f"""WITH {TAKES}, t AS (SELECT *, score % 3 = 0 AS clean FROM takes)
SELECT rec, kind, attempt, id, clean FROM t QUALIFY row_number() OVER (PARTITION BY rec, kind ORDER BY clean DESC, CASE WHEN clean THEN -attempt ELSE score END DESC, attempt) = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.best_attempt(fx.takes(spark, sf_dir), ["rec", "kind"], F.col("score") % 3 == 0)


STEPS = "steps AS (SELECT user_id AS rec, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CAST(floor(value * 100) AS BIGINT) AS score FROM events)"


@query(f"""WITH {STEPS}, b AS (SELECT *, coalesce(score < min(score) OVER (PARTITION BY rec ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM steps),
r AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY step) AS run FROM b), s AS (SELECT *, row_number() OVER (PARTITION BY rec, run ORDER BY step) - 1 AS stalled FROM r)
SELECT rec, id, step, score, stalled FROM s WHERE step <= coalesce((SELECT min(step) FROM s z WHERE z.rec = s.rec AND z.stalled >= 3), step)""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = fx.table(spark, sf_dir, "events")
    steps = events.select(F.col("user_id").alias("rec"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"), F.floor(F.col("value") * 100).alias("score"))
    return rank.early_stop(steps, ["rec"], "step", "score").select("rec", "id", "step", "score", F.col("stalled").cast("long").alias("stalled"))


@query(
    f"""WITH crc AS MATERIALIZED ({CRC_TABLE}), g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), h AS (SELECT source, n, {crc("source || ':7'")} % 1048576 AS h FROM g, crc),
b AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM h)
SELECT source, n, before < greatest(12, total // 12) AS held FROM b"""
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents, whole ones held out in hash order."""
    groups = fx.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rank.hold_out(groups, "source", "n")


@query(
    """WITH RECURSIVE c AS (SELECT user_id AS pool, event_id AS id, event_type AS source, event_id % 50 AS number, value AS distance, CAST(event_id % 9 + 1 AS DOUBLE) AS seconds FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY distance, id) AS k FROM c),
r AS (SELECT pool, 0::BIGINT AS k, []::VARCHAR[] AS used, 0.0::DOUBLE AS total, NULL::BIGINT AS picked FROM (SELECT DISTINCT pool FROM c)
      UNION ALL SELECT pool, k, CASE WHEN free THEN list_append(used, source || ':' || number) ELSE used END, CASE WHEN free THEN total + seconds ELSE total END, CASE WHEN free THEN id END
      FROM (SELECT r.pool, o.k, used, total, o.source, o.number, o.seconds, o.id,
                   NOT list_contains(used, o.source || ':' || o.number) AND NOT list_contains(used, o.source || ':' || (o.number - 1)) AND NOT list_contains(used, o.source || ':' || (o.number + 1)) AS free
            FROM r JOIN o ON o.pool = r.pool AND o.k = r.k + 1 WHERE total < 60))
SELECT pool, picked AS id FROM r WHERE picked IS NOT NULL"""
)
def greedy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of each user by distance until 60 seconds: the choice depends on what was chosen before."""
    rows = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("pool"), F.col("event_id").alias("id"), F.col("event_type").alias("source"), (F.col("event_id") % 50).alias("number"), F.col("value").alias("distance"), (F.col("event_id") % 9 + 1).cast("double").alias("seconds"))
    return rank.greedy_pick(rows, 60.0)
