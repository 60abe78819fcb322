"""Queries over edits of script lines: results by id, states, extents, batches, placement, names and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import editing as ops
from timeloom.sources import fixtures as fx

from .registry import query
from .views import FRAMES, LINES, SCRIPTED, TAKES, squash


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.lines(fx.spans(spark, sf_dir))


def _scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scripted(_lines(spark, sf_dir))



@query(f"""WITH {SCRIPTED} SELECT rec, id, CASE WHEN id % 4 = 0 AND say = original THEN upper(original) ELSE say END AS say, id % 4 = 0 AND say = original AS written FROM scripted""")
def rewrites_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _scripted(spark, sf_dir)
    return ops.apply_rewrites(lines, lines.where("id % 4 = 0").select("id", F.upper("original").alias("after"))).select("rec", "id", "say", "written")


@query(f"""WITH {SCRIPTED} SELECT rec, id, say, CASE WHEN id % 3 = 0 THEN len + 1 ELSE len END AS len, CASE WHEN id % 6 = 3 THEN hold + 1 ELSE hold END AS hold FROM scripted""")
def results_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _scripted(spark, sf_dir)
    results = lines.where("id % 3 = 0").select("id", (F.col("len") + 1).alias("len"), F.when(F.col("id") % 2 == 1, F.col("hold") + 1).alias("hold"))
    return ops.absorb(lines, results, ["len", "hold"]).select("rec", "id", "say", "len", "hold")


@query(
    f"""WITH {SCRIPTED},
m AS (SELECT *, coalesce(machine, CASE WHEN id % 6 = 1 THEN 'Given ' || (id % 97) WHEN id % 3 <> 0 THEN 'Flow ' || (id % 97) END, original) AS machine_say FROM scripted)
SELECT rec, ord, id, machine_say, {squash("say")} <> {squash("machine_say")} AS by_hand FROM m"""
)
def machine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _scripted(spark, sf_dir)
    text = lambda word: F.concat(F.lit(word + " "), (F.col("id") % 97).cast("string")).alias("text")
    done = ops.machine_text(lines, lines.where("id % 3 <> 0").select("rec", "ord", text("Flow")), lines.select("rec", "ord", text("Given")), lines.where("id % 6 = 1").select("rec", "ord"))
    return done.select("rec", "ord", "id", "machine_say", "by_hand")


@query(f"""WITH {SCRIPTED} SELECT rec, id, 'n' || (id % 5) AS note FROM scripted WHERE id % 3 = 0 AND NOT dropped AND NOT locked AND {squash("CASE WHEN id % 6 = 0 THEN say ELSE original END")} = {squash("say")}""")
def notes_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _scripted(spark, sf_dir)
    notes = lines.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, F.col("say")).otherwise(F.col("original")).alias("against"), F.concat(F.lit("n"), (F.col("id") % 5).cast("string")).alias("note"))
    return ops.pinned_notes(lines, notes).select("rec", "id", "note")


@query(
    f"""WITH {LINES}, b AS (SELECT DISTINCT rec, ord // 10 AS batch FROM lines)
SELECT l.rec, batch, CASE WHEN ord < batch * 10 THEN 'before' WHEN ord >= batch * 10 + 10 THEN 'after' ELSE 'line' END AS role, ord, id
FROM b JOIN lines l ON l.rec = b.rec AND ord BETWEEN batch * 10 - 2 AND batch * 10 + 11"""
)
def batch_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batch_context(_lines(spark, sf_dir), 10)


@query(
    f"""WITH {SCRIPTED} SELECT rec, id, CASE WHEN dropped THEN 'dropped' WHEN locked THEN 'real' WHEN NOT audio THEN 'todo' WHEN id % 6 = 0 OR id % 10 <> id % 5 THEN 'stale' ELSE 'done' END AS state,
CASE WHEN audio AND id % 9 = 0 THEN 'unchecked' WHEN id % 9 <> 0 AND id % 8 <> 1 THEN 'suspect' END AS checked FROM scripted"""
)
def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.when(F.col("id") % 6 != 0, F.col("id") % 10)
    score = F.when(F.col("id") % 9 != 0, F.col("len"))
    state = ops.line_state(F.col("dropped"), F.col("locked"), F.col("audio"), rendered, F.col("id") % 5)
    return _scripted(spark, sf_dir).select("rec", "id", state.alias("state"), ops.check_state(F.col("audio"), score, F.col("id") % 8 == 1).alias("checked"))


@query(
    f"""WITH {SCRIPTED}, t AS (SELECT *, audio AND NOT locked AND NOT dropped AS take FROM scripted),
p AS (SELECT *, start + CASE WHEN take THEN "offset" ELSE 0 END AS f, CASE WHEN take AND len > 0 THEN CAST(floor(len * stretch_milli / 1000) AS BIGINT) ELSE "end" - start END + CASE WHEN take THEN hold ELSE 0 END AS n FROM t)
SELECT rec, id, f AS "from", f + n AS until FROM p"""
)
def block_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.block_span(_scripted(spark, sf_dir)).select("rec", "id", "from", "until")


@query(f"""WITH {LINES} SELECT rec, id, id % 12 > 0 AND len * 26000 < (id % 12) * 3600000 AS short FROM lines WHERE NOT dropped AND NOT locked""")
def short_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("NOT dropped AND NOT locked").select("rec", "id", ops.too_short(F.col("id") % 12, F.col("len")).alias("short"))


@query(f"""WITH {LINES}, n AS (SELECT rec, max(start) AS total FROM lines GROUP BY rec) SELECT rec, total, CAST(total - coalesce(sum(CASE WHEN id % 6 = 0 THEN greatest(0, least("end", total) - start) END), 0) AS BIGINT) AS "left" FROM lines JOIN n USING (rec) GROUP BY rec, total""")
def left_after_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return ops.after_cuts(lines.groupBy("rec").agg(F.max("start").alias("total")), lines.where("id % 6 = 0").select("rec", F.col("start").alias("a"), F.col("end").alias("b")))


@query(
    f"""WITH {TAKES} SELECT rec, kind, attempt, score FROM takes WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY rec, kind ORDER BY CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN 1 ELSE 0 END DESC, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END DESC,
CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END DESC, CASE WHEN id % 5 = 0 THEN score ELSE score // 10 END DESC, score DESC, id % 9, attempt) = 1"""
)
def verdict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = fx.takes(spark, sf_dir).where("score >= 0").withColumns({"ok": F.col("id") % 3 == 0, "why": F.when(F.col("id") % 4 == 0, "tail").otherwise("head"), "missing": F.col("id") % 2, "tail_db": F.col("id") % 9})
    return ops.best_verdict(takes.withColumn("exact", F.when(F.col("id") % 5 != 0, F.floor(F.col("score") / 10))), ["rec", "kind"])


@query(f"""WITH {LINES} SELECT rec, id, start FROM lines QUALIFY row_number() OVER (PARTITION BY rec ORDER BY start DESC, id DESC) <= 2""")
def newest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.newest(_lines(spark, sf_dir), ["rec"], ["start", "id"]).select("rec", "id", "start")


@query(
    f"""WITH {LINES}, s AS (SELECT rec, start AS a, "end" AS b FROM lines WHERE id % 3 = 0), f AS (SELECT rec, id, start AS a, start + 600000 AS b FROM lines WHERE id % 3 = 1),
c AS (SELECT f.rec, f.id, greatest(0, f.a - 120000, coalesce(max(CASE WHEN s.b <= f.a THEN s.b END), 0)) AS lo, least(f.b + 120000, coalesce(min(CASE WHEN s.a >= f.b THEN s.a END), f.b + 120000)) AS hi
FROM f LEFT JOIN s USING (rec) GROUP BY f.rec, f.id, f.a, f.b HAVING count(CASE WHEN s.a <= f.a AND f.b <= s.b THEN 1 END) = 0)
SELECT rec, id, lo, hi FROM c WHERE hi > lo"""
)
def fillers_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    fillers = lines.where("id % 3 = 1").select("rec", "id", F.col("start").alias("a"), (F.col("start") + 600_000).alias("b"))
    return ops.clamped_fillers(fillers, lines.where("id % 3 = 0").select("rec", F.col("start").alias("a"), F.col("end").alias("b")), 120_000)


@query(
    f"""WITH {LINES}, g AS (SELECT rec, id, start AS lo, start + (id % 40) * 100 AS hi, start + (id % 7) * 500 AS "at", id % 12 AS words FROM lines),
p AS (SELECT *, CASE WHEN hi - lo - 300 >= 800 THEN least(greatest("at", lo + 150), hi - 950) END AS s FROM g)
SELECT rec, id, s AS start, CAST(floor(least(hi - 150, s + greatest(800, CASE WHEN words > 0 THEN words * 10000 / 29 + 400 ELSE 2000 END))) AS BIGINT) AS "end" FROM p WHERE s IS NOT NULL"""
)
def blocks_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _lines(spark, sf_dir).select("rec", "id", F.col("start").alias("lo"), (F.col("start") + F.col("id") % 40 * 100).alias("hi"), (F.col("start") + F.col("id") % 7 * 500).alias("at"), (F.col("id") % 12).alias("words"))
    return ops.place_added(gaps).where("start IS NOT NULL").select("rec", "id", "start", "end")


@query(f"""WITH {LINES} SELECT rec, ord, id, CAST(sum(len) OVER (PARTITION BY rec ORDER BY ord) - len AS BIGINT) AS begin FROM lines""")
def joined_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.part_offsets(_lines(spark, sf_dir).withColumnRenamed("len", "duration")).select("rec", "ord", "id", "begin")


@query(f"""WITH {LINES} SELECT rec, b AS a, c AS b FROM (SELECT rec, "end" AS b, lead(start) OVER (PARTITION BY rec ORDER BY start, "end") AS c FROM lines) WHERE c > b AND c - b <= 6000000""")
def slivers_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.slivers(_lines(spark, sf_dir).select("rec", F.col("start").alias("a"), F.col("end").alias("b")), 6_000_000)


@query(
    f"""WITH {LINES}, p AS (SELECT rec, ord, id % 40 * 50 AS length, CASE WHEN rec % 2 = 0 THEN -3000 ELSE 2000 END AS delta FROM lines),
r AS (SELECT *, CASE WHEN delta < 0 THEN greatest(0, length - 200) ELSE greatest(0, 1500 - length) END AS room FROM p),
t AS (SELECT *, sum(room) OVER (PARTITION BY rec) AS total FROM r), s AS (SELECT *, CASE WHEN total > 0 THEN room / total * least(abs(delta), total) ELSE 0.0 END AS share FROM t)
SELECT rec, ord, CAST(length + CASE WHEN delta < 0 THEN -share ELSE share END AS DOUBLE) AS want FROM s"""
)
def pauses_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    pauses = _lines(spark, sf_dir).select("rec", "ord", (F.col("id") % 40 * 50).alias("length"), F.when(F.col("rec") % 2 == 0, -3000).otherwise(2000).alias("delta"))
    return ops.pause_shares(pauses, 200, 1500).select("rec", "ord", "want")


@query(f"""WITH {LINES} SELECT rec, id, id % 7 AS grp FROM lines WHERE id % 7 > 1""")
def rows_not_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("rec", "id", (F.col("id") % 7).alias("grp"))
    return ops.without_groups(rows, rows.where("grp < 2"), "grp").select("rec", "id", "grp")


@query(
    f"""WITH {LINES}, f AS (SELECT rec, 'part' || (id % 1000) || '_' || rec AS name, id % 5 AS size, id FROM lines)
SELECT rec, name, size, row_number() OVER (PARTITION BY rec ORDER BY CAST(regexp_extract(name, '[0-9]+') AS BIGINT), name, size) AS nth FROM f WHERE (name, size) NOT IN (SELECT (name, size) FROM f WHERE id % 3 = 0)"""
)
def files_not_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("part"), (F.col("id") % 1000).cast("string"), F.lit("_"), F.col("rec").cast("string"))
    files = _lines(spark, sf_dir).select("rec", name.alias("name"), (F.col("id") % 5).alias("size"), "id")
    return ops.new_files(files.select("rec", "name", "size"), files.where("id % 3 = 0")).select("rec", "name", "size", "nth")


@query(f"""WITH {LINES} SELECT rec, id FROM lines WHERE id % 3 = 0 OR id % 4 = 0""")
def lines_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return ops.review_set(lines.where("id % 3 = 0"), lines.where("id % 4 = 0"))


@query(
    f"""WITH {LINES}, n AS (SELECT rec, 'n' || (id % 15) AS name, min(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END * 100000000 + ord) AS place FROM lines GROUP BY 1, 2)
SELECT rec, name, row_number() OVER (PARTITION BY rec ORDER BY place, name) AS nth FROM n QUALIFY nth <= 8"""
)
def names_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _lines(spark, sf_dir).select("rec", "ord", "id", F.concat(F.lit("n"), (F.col("id") % 15).cast("string")).alias("name"))
    return ops.first_names(names.where("id % 3 = 0"), names)


@query(
    f"""WITH {TAKES} SELECT kind, rec % 10 AS grp, count(*) AS takes, CAST(sum(CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong, round(sum(id % 5) * 60000 / sum(1000 + id % 1000), 1) AS clicks_per_min,
round(avg(60 + id % 200), 3) AS pace, round(stddev_pop(60 + id % 200), 3) AS pace_sd FROM takes GROUP BY 1, 2"""
)
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    takes = fx.takes(spark, sf_dir).select("kind", (F.col("rec") % 10).alias("grp"), (i % 7 == 0).alias("wrong"), (i % 5).alias("clicks"), (1000 + i % 1000).alias("ms"), (60 + i % 200).alias("pace"))
    return ops.candidate_metrics(takes, ["kind", "grp"])


@query(
    f"""WITH {LINES}, e AS (SELECT rec, start AS t, 1 AS k, NULL AS n, id AS base FROM lines WHERE id % 2 = 0 UNION ALL SELECT rec, start + 1, 0, id, NULL FROM lines WHERE id % 5 = 1),
p AS (SELECT rec, n, k, coalesce(last_value(base IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t, k, base ROWS UNBOUNDED PRECEDING), 0) AS base FROM e),
q AS (SELECT rec, n, base, row_number() OVER (PARTITION BY rec, base ORDER BY n) AS nth FROM p WHERE k = 0)
SELECT rec, n, base, CASE WHEN nth <= 26 THEN chr(CAST(96 + nth AS INTEGER)) END AS letter FROM q"""
)
def added_block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return ops.following_ids(lines.where("id % 2 = 0").select("rec", "id", "start"), lines.where("id % 5 = 1").select("rec", F.col("id").alias("n"), (F.col("start") + 1).alias("at")))


@query(
    f"""WITH {LINES}, c AS (SELECT rec, start AS slice FROM lines WHERE id % 8 = 0 UNION SELECT rec, "end" FROM lines WHERE id % 8 = 0), s AS (SELECT rec, start AS slice FROM lines WHERE id % 4 = 0 EXCEPT SELECT rec, slice FROM c),
a AS (SELECT DISTINCT rec, start + id % 701 - 350 AS "at" FROM lines WHERE id % 5 = 0)
SELECT rec, "at", slice FROM a JOIN s USING (rec) WHERE abs(slice - "at") <= 350 QUALIFY row_number() OVER (PARTITION BY rec, "at" ORDER BY abs(slice - "at"), slice DESC) = 1"""
)
def slices_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    cuts = lines.where("id % 8 = 0").select("rec", F.col("start").alias("a"), F.col("end").alias("b"))
    return ops.unslice(lines.where("id % 4 = 0").select("rec", F.col("start").alias("at")), cuts, lines.where("id % 5 = 0").select("rec", (F.col("start") + F.col("id") % 701 - 350).alias("at")).distinct())


@query(f"""WITH {LINES}, i AS (SELECT *, sum(CASE WHEN id % 3 = 0 AND ord > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY ord) AS island FROM lines) SELECT rec, CAST(island AS BIGINT) AS island, min(start) AS a, max("end") AS b FROM i GROUP BY 1, 2""")
def ranges_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rejoined(_lines(spark, sf_dir).select("rec", "ord", F.col("start").alias("a"), F.col("end").alias("b"), (F.col("id") % 3 == 0).alias("abandoned")))


@query(f"""WITH {SCRIPTED} SELECT rec, id, CASE WHEN id % 3 = 0 THEN 1000 ELSE stretch_milli END AS stretch_milli, CASE WHEN id % 3 = 0 THEN 0 ELSE "offset" END AS "offset", CASE WHEN id % 3 = 0 THEN 0 ELSE hold END AS hold FROM scripted""")
def tweaks_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _scripted(spark, sf_dir)
    return ops.reset_tweaks(lines, lines.where("id % 3 = 0")).select("rec", "id", "stretch_milli", "offset", "hold")


@query(
    f"""WITH {FRAMES}, l AS (SELECT rec, k, k - lag(k) OVER (PARTITION BY rec ORDER BY k) - 1 AS gap FROM frames WHERE abs(v) > 100)
SELECT rec, CAST(count(*) + sum(CASE WHEN gap BETWEEN 1 AND 2 THEN gap ELSE 0 END) AS BIGINT) AS live FROM l GROUP BY rec"""
)
def speaking_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.speaking(fx.frames(spark, sf_dir), 100, 2)
