"""Queries over what holds at an instant, refused slices, room between lines, gaps around words and profiles of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators import bounds as ops
from timeloom.operators import history, reports
from timeloom.sources import documents as docs
from timeloom.sources import fixtures as fx

from .registry import query
from .views import FRAMES, LINES, SCRIPTED, WORDS

_ASKED = f"""{LINES},
asked AS (SELECT rec, id, CASE id % 4 WHEN 0 THEN start WHEN 1 THEN "end" WHEN 2 THEN start - 30000000 ELSE start + 600000 END AS t FROM lines),
blocks AS (SELECT rec, id, start AS a, "end" AS b FROM lines WHERE NOT dropped AND id % 3 = 0), cuts AS (SELECT rec, id, start AS a, "end" AS b FROM lines WHERE id % 7 = 1)"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines, instants around them, every third as a block and every seventh as a cut."""
    lines = fx.lines(fx.spans(spark, sf_dir))
    kind = F.col("id") % 4
    asked = lines.select("rec", "id", F.when(kind == 0, F.col("start")).when(kind == 1, F.col("end")).when(kind == 2, F.col("start") - 30_000_000).otherwise(F.col("start") + 600_000).alias("t"))
    span = lambda rows: rows.select("rec", "id", F.col("start").alias("a"), F.col("end").alias("b"))
    return lines, asked, span(lines.where("NOT dropped AND id % 3 = 0")), span(lines.where("id % 7 = 1"))


@query(
    f"""WITH {_ASKED}
SELECT q.rec, q.id, t, arg_min(b.id, (b.a, b.id)) AS span, 'block' AS kind FROM asked q JOIN blocks b ON b.rec = q.rec AND t > b.a AND t < b.b GROUP BY q.rec, q.id, t
UNION ALL SELECT q.rec, q.id, t, arg_min(c.id, (c.a, c.id)), 'cut' FROM asked q JOIN cuts c ON c.rec = q.rec AND t BETWEEN c.a AND c.b GROUP BY q.rec, q.id, t
UNION ALL SELECT q.rec, q.id, t, c.id, 'mask' FROM asked q JOIN cuts c ON c.rec = q.rec AND t BETWEEN c.a AND c.b"""
)
def held_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that plays at an instant (open ends), the cut that it lies in (closed, the first), and all masks that show (closed)."""
    _, asked, blocks, cuts = _asked(spark, sf_dir)
    named = lambda rows, kind: rows.select("rec", "id", "t", "span", F.lit(kind).alias("kind"))
    return named(ops.at_point(asked, blocks, open_ends=True, first=True), "block").unionByName(named(ops.at_point(asked, cuts, first=True), "cut")).unionByName(named(ops.at_point(asked, cuts), "mask"))


@query(
    f"""WITH {_ASKED}, slices AS (SELECT rec, start - 30000000 + 25 * (id % 5) AS pos FROM lines WHERE id % 2 = 0), ends AS (SELECT rec, max("end") AS total FROM lines GROUP BY rec)
SELECT q.rec, q.id, t AS "at", CASE WHEN EXISTS (SELECT 1 FROM blocks b WHERE b.rec = q.rec AND t > b.a AND t < b.b) THEN 'block' WHEN EXISTS (SELECT 1 FROM cuts c WHERE c.rec = q.rec AND t BETWEEN c.a AND c.b) THEN 'cut'
    WHEN t < 50 OR t > total - 50 THEN 'edge' WHEN EXISTS (SELECT 1 FROM slices s WHERE s.rec = q.rec AND abs(s.pos - t) < 50) THEN 'near' END AS why FROM asked q JOIN ends USING (rec)"""
)
def slices_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, asked, blocks, cuts = _asked(spark, sf_dir)
    slices = lines.where("id % 2 = 0").select("rec", (F.col("start") - 30_000_000 + 25 * (F.col("id") % 5)).alias("at"))
    return ops.slice_verdicts(asked.withColumnRenamed("t", "at"), slices, blocks, cuts, lines.groupBy("rec").agg(F.max("end").alias("total")))


@query(
    f"""WITH {SCRIPTED}, l AS (SELECT rec, id, ord, start, start + "offset" AS placed, CASE WHEN len > 0 THEN len ELSE "end" - start END AS length, hold, max("end") OVER (PARTITION BY rec) AS extent FROM scripted WHERE NOT dropped),
n AS (SELECT *, placed + length + hold AS block_end, lag(placed + length + hold) OVER w AS before, lead(placed) OVER w AS after, lead(start) OVER w AS after_start FROM l WINDOW w AS (PARTITION BY rec ORDER BY ord))
SELECT rec, id, coalesce(before + 20, 0) - start AS least, CASE WHEN after IS NULL THEN extent ELSE greatest(after, after_start) - 20 END - start - length AS most,
       CASE WHEN after IS NOT NULL AND block_end - greatest(after, 0) > 60 THEN block_end - greatest(after, 0) ELSE 0 END AS over,
       CAST(greatest(850, least(1250, floor((CASE WHEN after IS NULL THEN extent ELSE after - 50 END - placed) * 1000 / greatest(length, 50)))) AS BIGINT) AS room_permille FROM n"""
)
def line_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.line_bounds(fx.scripted(fx.lines(fx.spans(spark, sf_dir))))


@query(f"WITH {WORDS} SELECT rec, idx, coalesce(start_ms - lag(end_ms) OVER w, 99000) AS before, coalesce(lead(start_ms) OVER w - end_ms, 99000) AS after FROM words WINDOW w AS (PARTITION BY rec ORDER BY idx)")
def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.word_gaps(fx.words(spark, sf_dir)).select("rec", "idx", "before", "after")


@query(
    f"""WITH {FRAMES}, p AS (SELECT rec, k // 8 AS win, sum(v * v) AS energy FROM frames GROUP BY 1, 2 HAVING count(*) = 8),
i AS (SELECT rec, list_sort(list(energy))[CAST(least(count(*) - 1, floor(count(*) * 0.05)) AS BIGINT) + 1] AS floor, list_sort(list(energy))[CAST(least(count(*) - 1, floor(count(*) * 0.9)) AS BIGINT) + 1] AS speech FROM p GROUP BY rec),
r AS (SELECT *, CASE WHEN abs(v) >= 250 THEN 1 WHEN v = 0 THEN 2 ELSE 0 END AS kind FROM frames), g AS (SELECT *, k - row_number() OVER (PARTITION BY rec, kind ORDER BY k) AS run FROM r),
u AS (SELECT rec, kind, count(*) AS n, max(abs(v)) AS peak FROM g GROUP BY rec, kind, run),
s AS (SELECT rec, max(peak) AS peak, sum(n) AS total, coalesce(sum(n) FILTER (kind = 1), 0) AS over, coalesce(max(n) FILTER (kind = 1), 0) AS longest_over, coalesce(sum(n) FILTER (kind = 2), 0) AS zeros, count(*) FILTER (kind = 2 AND n > 1) AS holes FROM u GROUP BY rec),
d AS (SELECT rec, 10 * log10(greatest(CAST(floor AS DOUBLE) / 8, 1e-9) / 1000000.0::DOUBLE) AS f, 10 * log10(greatest(CAST(speech AS DOUBLE) / 8, 1e-9) / 1000000.0::DOUBLE) AS e FROM i)
SELECT rec, round(f, 3) AS floor_db, round(e, 3) AS speech_db, round(e - f, 3) AS snr_db, peak, CAST(floor(1000 * over / total) AS BIGINT) AS clip_permille, longest_over, CAST(floor(1000 * zeros / total) AS BIGINT) AS zero_permille, holes FROM s JOIN d USING (rec)"""
)
def clip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.clip_profile(fx.frames(spark, sf_dir), window=8, ceiling=250, full=1000.0, hole=1)
    return found.withColumns({c: F.round(c, 3) for c in ("floor_db", "speech_db", "snr_db")})


@query(
    f"""WITH {FRAMES}, t AS (SELECT * FROM frames WHERE k < 40 + rec % 25 AND rec % 50 <> 49), r AS (SELECT rec, count(*) AS raw_frames FROM frames WHERE rec % 9 <> 0 GROUP BY rec)
SELECT t.rec, count(*) AS frames, max(abs(v)) AS peak, round(sqrt(CAST(sum(v * v) AS BIGINT) / count(*)), 6) AS rms, any_value(raw_frames) AS raw_frames, count(*) < 0.9 * any_value(raw_frames) AS shortened FROM t LEFT JOIN r USING (rec) GROUP BY t.rec"""
)
def take_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir)
    found = ops.take_listing(frames.where("k < 40 + rec % 25 AND rec % 50 <> 49"), frames.where("rec % 9 <> 0"))
    return found.withColumn("rms", F.round("rms", 6))


@query(
    f"""WITH {FRAMES}, z AS (SELECT rec, count(*) / 8 AS seconds, max(abs(v)) AS top FROM frames GROUP BY rec), l AS (SELECT f.rec, quantile_cont(abs(v), 0.5) AS level FROM frames f JOIN z ON z.rec = f.rec AND abs(v) >= 0.25 * top GROUP BY f.rec),
c AS (SELECT rec, count(*) AS many FROM frames WHERE v % 17 = 0 GROUP BY rec), w AS (SELECT conv_id AS rec, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))) AS words FROM conversations GROUP BY 1)
SELECT z.rec, seconds, CAST(coalesce(words, 0) AS BIGINT) * 60 / seconds AS pace, coalesce(many, 0) * 60 / seconds AS clicks_per_minute, level FROM z JOIN l USING (rec) LEFT JOIN c USING (rec) LEFT JOIN w USING (rec)"""
)
def clip_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir)
    words = fx.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("rec")).agg(F.sum(F.regexp_count("text", F.lit("[^ \t\n\r]+"))).alias("words"))
    return ops.clip_measures(frames, frames.where("v % 17 = 0").select("rec", "k"), words, per_second=8, within=0.25)


@query(
    """WITH p AS (SELECT user_id, event_id, event_id % 40 AS step, CASE WHEN event_id % 3 = 0 THEN 'config.json' ELSE 'weights.bin' END AS name FROM events WHERE user_id IS NOT NULL AND event_id % 11 <> 0),
c AS (SELECT DISTINCT 'v' || user_id AS run, step FROM p WHERE name = 'config.json') SELECT run, step, max(step) OVER (PARTITION BY run) AS newest FROM c"""
)
def checkpoint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and steps with a configuration, from the names of files; some lie elsewhere."""
    rows = fx.table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    name = F.when(F.col("event_id") % 3 == 0, "config.json").otherwise("weights.bin")
    folder = F.when(F.col("event_id") % 11 == 0, "/step_x/").otherwise(F.concat(F.lit("/step_"), (F.col("event_id") % 40).cast("string"), F.lit("/")))
    return docs.checkpoints(rows.select(F.concat(F.lit("/voices/v"), F.col("user_id").cast("string"), folder, name).alias("path")))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'h264' END AS codec, CASE WHEN event_id % 5 <> 0 THEN 640 + event_id % 7 END AS width, CASE WHEN event_id % 5 <> 0 THEN 360 END AS height,
CASE WHEN event_id % 5 <> 0 THEN (24 + event_id % 3) || '/1' END AS rate FROM events WHERE props IS NOT NULL"""
)
def probed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main stream of probes that have sound and thumbnails too; every fifth has no picture."""
    rows = fx.table(spark, sf_dir, "events").where("props IS NOT NULL")
    i = F.col("event_id")
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":'), (640 + i % 7).cast("string"), F.lit(',"height":360,"r_frame_rate":"'), (24 + i % 3).cast("string"), F.lit('/1","disposition":{"attached_pic":0}}'))
    cover = F.lit('{"codec_type":"video","codec_name":"mjpeg","width":90,"height":90},{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h265","width":1,"disposition":{"attached_pic":1}}')
    probe = F.concat(F.lit('{"streams":['), F.when(i % 5 == 0, cover).otherwise(F.concat_ws(",", cover, video)), F.lit('],"tags":'), "props", F.lit("}"))
    return rows.select("event_id", F.explode(F.array(docs.main_stream(probe))).alias("s")).select("event_id", "s.*")


@query(
    f"""WITH {SCRIPTED}, v AS (SELECT rec, ord AS n, CASE id % 5 WHEN 0 THEN 'polish' WHEN 1 THEN 'rejected' WHEN 2 THEN 'drop' END AS kind, CASE WHEN id % 5 = 1 THEN 'long' END AS why, CASE WHEN id % 5 IN (0, 3) THEN say END AS text FROM scripted)
SELECT rec, count(*) FILTER (kind IN ('polish', 'drop')) AS suggested, count(*) FILTER (kind = 'rejected') AS rejected, count(*) FILTER (kind IS NULL AND text IS NULL) AS unanswered,
       coalesce(min(n) FILTER (kind = 'polish'), -1) AS first_polish, coalesce(max(n) FILTER (kind IS NULL AND text IS NULL), -1) AS last_unanswered FROM v GROUP BY rec"""
)
def suggestion_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each recording's suggestions, and what its JSON document says when it is read again."""
    lines = fx.scripted(fx.lines(fx.spans(spark, sf_dir)))
    k = F.col("id") % 5
    verdicts = lines.select("rec", F.col("ord").alias("n"), F.when(k == 0, "polish").when(k == 1, "rejected").when(k == 2, "drop").alias("kind"), F.when(k == 1, "long").alias("why"), F.when(k.isin(0, 3), F.col("say")).alias("text"))
    found = docs.suggestion_documents(verdicts, ["rec"])
    read = F.from_json("document", "suggestions array<struct<n: long, kind: string>>, unanswered_lines array<long>")
    polish = F.get(F.filter(read["suggestions"], lambda s: s["kind"] == "polish"), F.lit(0))["n"]
    counts = [F.col(c).cast("long").alias(c) for c in ("suggested", "rejected", "unanswered")]
    return found.select("rec", *counts, F.coalesce(polish, F.lit(-1).cast("long")).alias("first_polish"), F.coalesce(F.try_element_at(read["unanswered_lines"], F.lit(-1)), F.lit(-1).cast("long")).alias("last_unanswered"))


@query(
    f"""WITH {LINES}, n AS (SELECT rec, id, id % 1700 - 1000 AS tail, id % 5 AS flat, id % 1900 AS pause, id % 4 AS k FROM lines)
SELECT rec, id, array_to_string(list_filter([CASE WHEN tail > -800 THEN 'tail' END, CASE WHEN flat >= 2 THEN 'clipped' END, CASE WHEN pause >= 1200 THEN 'pause' END], lambda x: x IS NOT NULL), ',') AS faults, CASE WHEN k = 0 THEN 'accepted' WHEN k = 1 THEN 'dismissed' ELSE 'open' END AS status FROM n"""
)
def take_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a take's sound, and what was said of its suggestion in two updates of a map by id."""
    lines = fx.lines(fx.spans(spark, sf_dir))
    i = F.col("id")
    key = i.cast("string")
    stored = F.create_map(key, F.lit("open"), F.lit("other"), F.lit("open"))
    first = history.statuses(stored, F.when(i % 4 < 2, F.array(key)).otherwise(F.array(F.lit("other"))), F.lit("dismissed"))
    both = history.statuses(first, F.when(i % 4 == 0, F.array(key)).otherwise(F.array().cast("array<string>")), F.lit("accepted"))
    return lines.select("rec", "id", F.array_join(reports.noisy(i % 1700 - 1000, i % 5, i % 1900), ",").alias("faults"), F.try_element_at(both, key).alias("status"))
