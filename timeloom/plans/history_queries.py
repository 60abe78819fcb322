"""Queries over tables with a past, layered settings, reports and checks of takes and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.operators import frames, history, reports
from timeloom.sources import fixtures as fx

from .line_queries import RUNS
from .registry import query
from .views import FRAMES, LINES, SCRIPTED, SPANS, WORDS
from .word_queries import FLAGS, _flags

# a pointer moves when an event names another value than before; the last of one instant counts
_VERSIONS = f"""{SPANS},
moves AS (SELECT rec, a AS moved_at, id % 5 AS checkpoint, id % 3 AS sample FROM spans QUALIFY row_number() OVER (PARTITION BY rec, a ORDER BY id DESC) = 1),
fresh AS (SELECT * FROM moves WINDOW w AS (PARTITION BY rec ORDER BY moved_at) QUALIFY lag(checkpoint) OVER w IS NULL OR lag(checkpoint) OVER w <> checkpoint OR lag(sample) OVER w <> sample),
versions AS (SELECT rec, row_number() OVER w AS version, checkpoint, sample, moved_at AS valid_from, lead(moved_at) OVER w AS valid_to FROM fresh WINDOW w AS (PARTITION BY rec ORDER BY moved_at))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = fx.spans(spark, sf_dir).select("rec", F.col("a").alias("at"), "id", (F.col("id") % 5).alias("checkpoint"), (F.col("id") % 3).alias("sample"))
    return history.versions(moves, ["rec"], ["id"], ["checkpoint", "sample"])


@query(f"WITH {_VERSIONS} SELECT * FROM versions")
def pointer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query(
    f"""WITH {_VERSIONS}, now AS (SELECT * FROM versions WHERE valid_to IS NULL), past AS (SELECT * FROM versions WHERE version = 2),
back AS (SELECT n.rec, p.checkpoint, p.sample, n.version, n.valid_from + 60000 AS since FROM now n JOIN past p ON p.rec = n.rec AND n.rec % 2 = 0 WHERE p.checkpoint <> n.checkpoint OR p.sample <> n.sample)
SELECT v.rec, v.version, v.checkpoint, v.sample, v.valid_from, CASE WHEN v.valid_to IS NULL THEN b.since ELSE v.valid_to END AS valid_to FROM versions v LEFT JOIN back b USING (rec)
UNION ALL SELECT rec, version + 1, checkpoint, sample, since, NULL FROM back"""
)
def pointers_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second recording gets back, a minute after its last move, what it was when its second version began."""
    past = _versions(spark, sf_dir)
    then = past.where("version = 2 AND rec % 2 = 0").select("rec", F.col("valid_from").alias("to"))
    wanted = past.where("valid_to IS NULL").select("rec", (F.col("valid_from") + 60_000).alias("at")).join(then, "rec")
    return history.rolled_back(past, wanted, ["rec"], ["checkpoint", "sample"])


@query(
    f"""WITH {SPANS}, first AS (SELECT rec, min(a) AS since FROM spans GROUP BY rec), profiles AS (SELECT rec, 's' || (id % 7) AS name, max(id % 100) AS score FROM spans GROUP BY ALL),
wishes AS (SELECT rec, 's' || (rec % 9) AS name, since + 10 AS moved_at FROM first), news AS (SELECT * FROM wishes JOIN profiles USING (rec, name))
SELECT f.rec, 1 AS version, 'none' AS name, CAST(0 AS BIGINT) AS score, since AS valid_from, n.moved_at AS valid_to FROM first f LEFT JOIN news n USING (rec)
UNION ALL SELECT rec, 2, name, score, moved_at, NULL FROM news"""
)
def samples_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's pointer moves to the sample that it asks for, with its best score, where it has one of that name."""
    spans = fx.spans(spark, sf_dir)
    first = spans.groupBy("rec").agg(F.min("a").alias("at"))
    past = history.versions(first.select("rec", "at", F.lit("none").alias("name"), F.lit(0).cast("long").alias("score")), ["rec"], [], ["name", "score"])
    wishes = first.select("rec", F.concat(F.lit("s"), (F.col("rec") % 9).cast("string")).alias("name"), (F.col("at") + 10).alias("at"))
    profiles = spans.select("rec", F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("name"), (F.col("id") % 100).alias("score"))
    done = history.changed(past, history.adopted(past, wishes, profiles, ["rec"]), ["rec"], ["name", "score"])
    return done.withColumn("version", F.col("version").cast("int"))


@query(
    f"""WITH {LINES}, {RUNS}, fine AS (SELECT rec, run FROM runs JOIN lines USING (rec, id) GROUP BY rec, run HAVING count(*) >= 2 AND max(ord) - min(ord) + 1 = count(*) AND NOT bool_or(dropped) AND bool_or(locked) = bool_and(locked)),
members AS (SELECT l.*, run, min(run) OVER () AS r0 FROM runs JOIN fine USING (rec, run) JOIN lines l USING (rec, id)),
whole AS (SELECT rec, run, min(ord) AS ord, arg_min(id, ord) AS id, min(start) AS start, max("end") AS "end", CAST(sum(len) AS BIGINT) AS len FROM members GROUP BY rec, run)
SELECT rec, ord, id, start, "end", len FROM lines l WHERE NOT EXISTS (SELECT 1 FROM members m JOIN whole w ON w.rec = m.rec AND w.run = m.run WHERE m.rec = l.rec AND m.id = l.id AND w.id % 2 = 1)
UNION ALL SELECT rec, ord, id, start, "end", len FROM whole WHERE id % 2 = 1"""
)
def merges_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines are merged, and the merges under even ids undone."""
    lines = fx.lines(fx.spans(spark, sf_dir))
    done, archive = history.merged(lines, lines.where("ord % 6 < 3").select("rec", F.floor(F.col("ord") / 3).alias("run"), "id"))
    back, _ = history.unmerged(done, archive, done.where("id % 2 = 0").select("rec", "id"))
    return back.select("rec", "ord", "id", "start", "end", "len")


_RANGE = T.StructType().add("low", "long").add("high", "long")
_VOICE = T.StructType().add("name", "string").add("speed", "long").add("range", _RANGE)
_SETTINGS = T.StructType().add("pace", "long").add("voice", _VOICE).add("terms", T.ArrayType(T.StringType()))

# a saved document, written from an event's own JSON
_SAVED = """saved AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL)"""


@query(
    f"""WITH {_SAVED}
SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN k END, CASE WHEN event_id % 2 = 0 THEN 150 END, 145) AS pace, coalesce(CASE WHEN k % 2 = 0 THEN 'v' || k END, CASE WHEN event_id % 5 = 0 THEN 'saved' END, 'none') AS voice_name,
       coalesce(CASE WHEN k % 4 = 0 THEN k + 1 END, 1) AS speed, coalesce(CASE WHEN k % 2 = 0 THEN k - 10 END, -5) AS low, 5 AS high,
       CASE WHEN k % 5 = 0 THEN 'Tabl,x' || k WHEN k % 5 = 1 THEN 'X' || k || ',tabl,y' ELSE 'Base' END AS terms
FROM saved"""
)
def settings_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over saved settings over defaults, field by field; the document is JSON made of the event's own."""
    k = F.from_json("props", "k DOUBLE")["k"].cast("long")
    rows = fx.table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", k.alias("k"))
    n = F.col("k").cast("string")
    part = lambda test, text: F.when(test, text)
    voice = F.concat_ws(",", part(F.col("k") % 2 == 0, F.concat(F.lit('"name":"v'), n, F.lit('"'))), part(F.col("k") % 4 == 0, F.concat(F.lit('"speed":'), (F.col("k") + 1).cast("string"))), part(F.col("k") % 2 == 0, F.concat(F.lit('"range":{"low":'), (F.col("k") - 10).cast("string"), F.lit("}"))))
    terms = F.when(F.col("k") % 5 == 0, F.concat(F.lit('["Tabl "," x'), n, F.lit('","TABL",""]'))).when(F.col("k") % 5 == 1, F.concat(F.lit('["X'), n, F.lit('","tabl"," ","x'), n, F.lit('","Tabl","y"]')))
    document = F.concat(F.lit("{"), F.concat_ws(",", part(F.col("k") % 3 == 0, F.concat(F.lit('"pace":'), n)), F.concat(F.lit('"voice":{'), voice, F.lit("}")), F.concat(F.lit('"terms":'), terms)), F.lit("}"))
    saved = F.concat(F.lit("{"), F.concat_ws(",", part(F.col("event_id") % 2 == 0, F.lit('"pace":150')), part(F.col("event_id") % 5 == 0, F.lit('"voice":{"name":"saved"}'))), F.lit("}"))
    defaults = F.lit('{"pace":145,"voice":{"name":"none","speed":1,"range":{"low":-5,"high":5}},"terms":["Base","base"]}')
    rows = rows.select("event_id", F.explode(F.array(F.struct(*[F.from_json(x, _SETTINGS).alias(c) for c, x in (("document", document), ("saved", saved), ("defaults", defaults))]))).alias("l"))
    done = rows.select("event_id", F.explode(F.array(history.layered(F.col("l.document"), F.col("l.saved"), F.col("l.defaults"), kind=_SETTINGS))).alias("s"))
    return done.select("event_id", "s.pace", F.col("s.voice.name").alias("voice_name"), F.col("s.voice.speed").alias("speed"), F.col("s.voice.range.low").alias("low"), F.col("s.voice.range.high").cast("int").alias("high"), F.array_join(history.tidy(F.col("s.terms")), ",").alias("terms"))


@query(
    f"""WITH {SPANS}, t AS (SELECT user_id AS rec, list_sort(list(DISTINCT event_type)) AS kinds FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id)
SELECT rec, list_aggregate(list_transform(kinds, lambda x: lower(x) || '=' || x || rec), 'string_agg', ',') AS aliases FROM t"""
)
def aliases_tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events as aliases, written with blanks, other cases and empty sides as well."""
    kinds = fx.table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL").groupBy(F.col("user_id").alias("rec")).agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    rec = F.col("rec").cast("string")
    first = F.transform("kinds", lambda x: F.struct(F.concat(F.lit(" "), F.upper(x)).alias("key"), F.concat(x, rec, F.lit(" ")).alias("value")))
    again = F.transform("kinds", lambda x: F.struct(F.concat(x, F.lit(" ")).alias("key"), F.lit("later").alias("value")))
    empty = F.array(F.struct(F.lit(" ").alias("key"), F.lit("x").alias("value")), F.struct(F.lit("none").alias("key"), F.lit(" ").alias("value")))
    tidy = F.map_entries(history.tidy_aliases(F.map_from_entries(F.concat(first, again, empty))))
    return kinds.select("rec", F.array_join(F.transform(tidy, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("aliases"))


@query(
    f"""WITH {LINES}, base AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY ord) AS id, start AS "from", "end" AS "to" FROM lines WHERE ord % 4 = 0),
added AS (SELECT rec, start AS "from", start - 5 AS "to" FROM lines WHERE ord % 9 = 1), numbered AS (SELECT a.rec, coalesce(last, 0) + row_number() OVER (PARTITION BY a.rec ORDER BY "from", "to") AS id, "from", "to" FROM added a LEFT JOIN (SELECT rec, max(id) AS last FROM base GROUP BY rec) USING (rec)),
done AS (SELECT rec, id, CASE WHEN id % 3 = 0 THEN "from" + 7 ELSE "from" END AS "from", CASE WHEN id % 6 = 0 THEN "from" ELSE "to" END AS "to" FROM base WHERE id % 5 <> 0 UNION ALL SELECT * FROM numbered)
SELECT rec, id, "from", greatest("from", "to") AS "to", row_number() OVER (PARTITION BY rec ORDER BY "from", id) AS place FROM done"""
)
def masks_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.lines(fx.spans(spark, sf_dir))
    base = lines.where("ord % 4 = 0").select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("ord")).cast("long").alias("id"), F.col("start").alias("from"), F.col("end").alias("to"))
    added = lines.where("ord % 9 = 1").select("rec", F.col("start").alias("from"), (F.col("start") - 5).alias("to"))
    patches = base.where("id % 3 = 0").select("rec", "id", (F.col("from") + 7).alias("from"), F.when(F.col("id") % 6 == 0, F.col("from")).alias("to"))
    return history.masked(base, added, patches, base.where("id % 5 = 0"))


@query(
    f"""WITH {SCRIPTED}, f AS (SELECT *, CASE WHEN id % 3 <> 0 THEN 'Flow ' || (id % 97) WHEN id % 6 = 0 THEN ' ' END AS text FROM scripted),
w AS (SELECT *, coalesce(text IS NOT NULL AND NOT locked AND trim(text) <> '' AND say = machine AND text <> say, false) AS written FROM f)
SELECT rec, id, CASE WHEN written THEN text ELSE say END AS say, CASE WHEN written THEN text ELSE machine END AS machine, CASE WHEN written THEN say END AS previous, written FROM w"""
)
def flow_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.scripted(fx.lines(fx.spans(spark, sf_dir)))
    flow = F.when(F.col("id") % 3 != 0, F.concat(F.lit("Flow "), (F.col("id") % 97).cast("string"))).when(F.col("id") % 6 == 0, F.lit(" "))
    return history.flowed(lines, lines.select("rec", "id", flow.alias("text")).where("text IS NOT NULL")).select("rec", "id", "say", "machine", "previous", "written")


@query(
    f"""WITH {FRAMES}, m AS (SELECT rec, max(abs(v)) AS peak, count(*) FILTER (v = 0) AS zeros, sum(v * v) AS energy, min(v) FILTER (rec % 3 = 0) AS lowest FROM frames GROUP BY rec),
l AS (SELECT rec // 2 AS pair, rec % 2 AS side, CAST(peak AS DOUBLE) AS peak, CAST(zeros AS DOUBLE) AS zeros, CAST(energy AS DOUBLE) AS energy, CAST(lowest AS DOUBLE) AS lowest FROM m),
u AS (SELECT * FROM l UNPIVOT INCLUDE NULLS (value FOR metric IN (peak, zeros, energy, lowest))),
d AS (SELECT coalesce(b.pair, a.pair) AS pair, coalesce(b.metric, a.metric) AS metric, b.value AS before, a.value AS after, a.value - b.value AS delta,
             CASE WHEN b.pair IS NULL THEN 'new' WHEN a.pair IS NULL THEN 'gone' WHEN b.value IS NOT DISTINCT FROM a.value THEN 'same' WHEN a.value > b.value THEN 'up' WHEN a.value < b.value THEN 'down' END AS change
      FROM (SELECT * FROM u WHERE side = 0) b FULL JOIN (SELECT * FROM u WHERE side = 1) a ON a.pair = b.pair AND a.metric = b.metric)
SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(delta) DESC NULLS LAST, pair) AS place, count(*) OVER (PARTITION BY metric) AS "of" FROM d QUALIFY place <= 6"""
)
def metrics_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even recordings before, the odd ones behind them after: all metrics compared, the six largest moves of each kind."""
    v = F.col("v")
    measures = fx.frames(spark, sf_dir).groupBy("rec").agg(F.max(F.abs(v)).alias("peak"), F.count_if(v == 0).alias("zeros"), F.sum(v * v).alias("energy"), F.min(F.when(F.col("rec") % 3 == 0, v)).alias("lowest"))
    rows = reports.long_metrics(measures.select(F.floor(F.col("rec") / 2).alias("pair"), (F.col("rec") % 2).alias("side"), "peak", "zeros", "energy", "lowest"), ["pair", "side"], ["peak", "zeros", "energy", "lowest"])
    compared = reports.before_after(rows.where("side = 0"), rows.where("side = 1"), ["pair"])
    return reports.first_of_each(compared, ["metric"], [F.abs("delta").desc_nulls_last(), F.col("pair")])


@query(f"""WITH {WORDS}, {FLAGS} SELECT rec, kind, idx, start_ms, row_number() OVER w AS place, count(*) OVER (PARTITION BY rec, kind) AS "of" FROM flags WHERE kind <> 'gap'
WINDOW w AS (PARTITION BY rec, kind ORDER BY CASE WHEN kind = 'low_conf' THEN p_milli ELSE 0 END, start_ms, idx) QUALIFY place <= 6""")
def worst_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six faults of each kind and recording: the least sure words, else the first."""
    flags = _flags(fx.words(spark, sf_dir)).where("kind <> 'gap'")
    order = [F.when(F.col("kind") == "low_conf", F.col("p_milli")).otherwise(0), F.col("start_ms"), F.col("idx")]
    return reports.first_of_each(flags, ["rec", "kind"], order).select("rec", "kind", "idx", "start_ms", "place", "of")


@query(
    f"""WITH {SCRIPTED}, s AS (SELECT rec, id, id % 4 AS k, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN id % 50 + 100 END AS pace, CASE WHEN id % 5 = 0 THEN ' slow ' WHEN id % 5 = 1 THEN '' END AS direction, say FROM scripted)
SELECT rec, id, CASE WHEN k = 0 THEN 'said "' || say || '" for "Line", said "x" for "y"' WHEN k = 1 THEN 'said the line, then kept making sound (tail ' || (id % 9 - 12) || ' dB)' ELSE 'did not say the line (' || (id % 100) || '): "' || left(say, 60) || '"' END AS reason,
       coalesce(nullif(pace, 0), 145) AS pace, trim(coalesce(direction, 'calm')) AS direction FROM s"""
)
def take_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a take failed, in words, and the pace and direction that hold for its line."""
    rows = fx.scripted(fx.lines(fx.spans(spark, sf_dir)))
    k, i = F.col("id") % 4, F.col("id")
    names = F.when(k == 0, F.array(F.struct(F.lit("Line").alias("wanted"), F.col("say").alias("heard")), F.struct(F.lit("y").alias("wanted"), F.lit("x").alias("heard"))))
    reason = reports.why_failed(names, F.when(k == 1, F.lit("tail")), i % 9 - 12, i % 100, F.col("say"))
    pace = F.when(i % 3 == 0, 0).when(i % 3 == 1, i % 50 + 100).cast("long")
    holds = reports.settings_for(pace, F.lit(145).cast("long"), F.when(i % 5 == 0, F.lit(" slow ")).when(i % 5 == 1, F.lit("")), F.lit("calm"))
    return rows.select("rec", "id", reason.alias("reason"), F.explode(F.array(holds)).alias("h")).select("rec", "id", "reason", "h.*")


@query(
    f"""WITH {SPANS}, s AS (SELECT rec, id, a % 100000 AS a, a % 100000 + id % 90 AS b, 320 + 16 * (id % 300) + id % 7 AS w, 200 + 9 * (id % 240) AS h, 24 + 12 * (id % 4) AS fps FROM spans),
z AS (SELECT *, (w // 16) * ((h + 15) // 16) * fps AS mbs FROM s), st AS (SELECT *, CAST(greatest(320, floor(floor(w * sqrt(850000 / mbs)) / 16) * 16) AS BIGINT) AS w0 FROM z),
c AS (SELECT rec, id, w, h, fps, mbs, w0, c, CAST(greatest(176, floor(round_even(c * h / w, 0) / 16) * 16) AS BIGINT) AS ch FROM st, unnest(range(w0, CASE WHEN w0 > 640 THEN w0 - 16 * CAST(ceil((w0 - 640) / 16) AS BIGINT) ELSE w0 END - 1, -16)) AS t(c)),
best AS (SELECT rec, id, c, ch FROM c QUALIFY row_number() OVER (PARTITION BY rec, id ORDER BY (c // 16) * ((ch + 15) // 16) * fps > 850000, CASE WHEN (c // 16) * ((ch + 15) // 16) * fps > 850000 THEN c ELSE -c END) = 1)
SELECT rec, id, CASE WHEN b - a > 60 THEN CAST(floor(a / 40 + 0.5) AS BIGINT) END AS first_frame, CASE WHEN mbs <= 850000 THEN w ELSE c END AS width, CASE WHEN mbs <= 850000 THEN h ELSE ch END AS height FROM st JOIN best USING (rec, id)"""
)
def pictures_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture sizes within a decoder's budget, and the first frame of ranges that are longer than one and a half."""
    i = F.col("id")
    rows = fx.spans(spark, sf_dir).select("rec", "id", (F.col("a") % 100_000).alias("a"), (F.col("a") % 100_000 + i % 90).alias("b"), (320 + 16 * (i % 300) + i % 7).alias("w"), (200 + 9 * (i % 240)).alias("h"), (24 + 12 * (i % 4)).alias("fps"))
    first = reports.snapped(rows.select(F.struct("rec", "id").alias("rec"), "a", "b"), 40).select("rec.*", F.col("first").alias("first_frame"))
    sizes = rows.select("rec", "id", F.explode(F.array(reports.fit_grid(F.col("w"), F.col("h"), F.col("fps")))).alias("s")).select("rec", "id", "s.*")
    return sizes.join(first, ["rec", "id"], "left").select("rec", "id", "first_frame", "width", "height")


@query(
    f"""WITH {FRAMES}, lv AS (SELECT rec, k, 20 * abs(v) - 6000 AS level, max(k) OVER (PARTITION BY rec) AS last FROM frames),
s AS (SELECT vec_id AS rec, id, 9 * id + vec_id % 5 AS a, 9 * id + vec_id % 5 + 3 + (vec_id + id) % 6 AS b FROM embeddings, unnest(range(7)) AS t(id)), keep AS (SELECT vec_id AS rec, q * 20 AS a, q * 20 + 12 AS b FROM embeddings, unnest(range(3)) AS t(q)),
i AS (SELECT s.* FROM s WHERE b - a >= 5 AND EXISTS (SELECT 1 FROM keep WHERE keep.rec = s.rec AND 2 * keep.a <= s.a + s.b AND s.a + s.b <= 2 * keep.b))
SELECT i.rec, id, a, b, max(level) AS peak FROM i JOIN lv ON lv.rec = i.rec AND k BETWEEN a AND b GROUP BY i.rec, id, a, b HAVING max(level) >= -1500 AND any_value(last) >= b AND a >= 0"""
)
def duckable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"))
    each = lambda n, name: recs.select("rec", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias(name))
    a = 9 * F.col("id") + F.col("rec") % 5
    spans = each(7, "id").select("rec", "id", a.alias("a"), (a + 3 + (F.col("rec") + F.col("id")) % 6).alias("b"))
    keep = each(3, "q").select("rec", (F.col("q") * 20).alias("a"), (F.col("q") * 20 + 12).alias("b"))
    levels = fx.frames(spark, sf_dir).select("rec", "k", (20 * F.abs("v") - 6000).alias("level"))
    return reports.duckable(spans, keep, levels, shortest=5, least=-1500)


@query(f"""WITH {FRAMES}, q AS (SELECT rec, k // 8 AS win, CAST(sum(v * v) AS BIGINT) AS energy FROM frames GROUP BY 1, 2), r AS (SELECT rec, win, win - row_number() OVER (PARTITION BY rec ORDER BY win) AS run FROM q WHERE win >= 2 AND energy < 120000),
f AS (SELECT rec, 100 * min(win) AS quiet FROM (SELECT rec, run, min(win) AS win FROM r GROUP BY rec, run HAVING count(*) >= 2) GROUP BY rec), n AS (SELECT rec, 100 * count(*) AS length FROM q GROUP BY rec)
SELECT rec, length, CASE WHEN quiet IS NULL OR NOT (length - quiet >= 300 AND quiet >= 300 AND quiet >= 0.4 * length) THEN length ELSE quiet END AS ends FROM n LEFT JOIN f USING (rec)""")
def tails_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = frames.levels(fx.frames(spark, sf_dir))
    quiet = frames.quiet_from(levels, 2, 120_000, 2).select("rec", (100 * F.col("win")).alias("quiet"))
    rows = levels.groupBy("rec").agg((100 * F.count(F.lit(1))).alias("length")).join(quiet, "rec", "left")
    return rows.select("rec", "length", reports.trimmed_end(F.col("length"), F.col("quiet"), 300, 0.4).alias("ends"))


@query(f"""WITH {LINES}, p AS (SELECT rec, count(*) AS parts, CAST(sum(len) AS BIGINT) AS total FROM lines WHERE NOT dropped GROUP BY rec), w AS (SELECT rec, CAST(sum(len) AS BIGINT) - CASE WHEN rec % 4 = 0 THEN 0 ELSE 100 * (rec % 40) END AS length FROM lines WHERE NOT dropped OR rec % 7 = 0 GROUP BY rec)
SELECT rec, coalesce(parts, 0) AS parts, coalesce(total, 0) AS total, length, abs(length - coalesce(total, 0)) <= 40 * coalesce(parts, 0) AS fine FROM w LEFT JOIN p USING (rec)""")
def joined_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.lines(fx.spans(spark, sf_dir))
    whole = lines.where("NOT dropped OR rec % 7 = 0").groupBy("rec").agg(F.sum("len").alias("length"))
    whole = whole.withColumn("length", F.col("length") - F.when(F.col("rec") % 4 == 0, 0).otherwise(100 * (F.col("rec") % 40)))
    return reports.joined_arithmetic(lines.where("NOT dropped").select("rec", F.col("ord").alias("part"), F.col("len").alias("length")), whole)


@query(
    f"""WITH {LINES}, s AS (SELECT rec, id, start AS a, "end" AS b, hold FROM lines WHERE NOT dropped)
SELECT rec, id, a, b + CASE WHEN hold > 10 THEN hold ELSE 0 END AS b, id % 7 = 0 AS held, CASE WHEN id % 3 <> 0 THEN 'Caption ' || id END AS caption FROM s"""
)
def placed_with_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed spans with the room that their lines were given, gaps that are held, and captions, all by id."""
    lines = fx.lines(fx.spans(spark, sf_dir)).where("NOT dropped")
    placed = lines.select("rec", "id", F.col("start").alias("a"), F.col("end").alias("b"))
    captions = lines.where("id % 3 <> 0").select("rec", "id", F.concat(F.lit("Caption "), F.col("id").cast("string")).alias("caption"))
    return history.with_room(placed, lines.select("rec", "id", "hold", (F.col("id") % 7 == 0).alias("held")), captions)


@query(
    """WITH r AS (SELECT doc_id AS audio, text, length(text) / 90.0 AS seconds, source FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 UNION ALL SELECT conv_id * 1000 + turn, text, length(text) / 60.0, role FROM conversations)
SELECT source, count(*) AS clips, CAST(sum(floor(seconds * 1000)) AS BIGINT) AS ms FROM r WHERE seconds BETWEEN 1.2 AND 18 AND len(regexp_extract_all(text, '[^ \t\n\r]+')) >= 3 GROUP BY source"""
)
def corpus_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of the read and the mined corpus that can be trained on, with their time by source."""
    read = fx.table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id % 2 = 0").select(F.col("doc_id").alias("audio"), "text", (F.length("text") / 90.0).alias("seconds"), "source")
    mined = fx.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("audio"), "text", (F.length("text") / 60.0).alias("seconds"), F.col("role").alias("source"))
    kept = reports.kept_clips(read, mined)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("clips"), F.sum(F.floor(F.col("seconds") * 1000)).cast("long").alias("ms"))
