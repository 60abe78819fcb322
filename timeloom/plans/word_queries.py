"""Queries over timed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import text as t
from timeloom.operators import detect, metrics, plan
from timeloom.sources import fixtures as fx

from .registry import query
from .views import WORDS, quoted

#: Stand-ins for the filler lists: the test texts have none of the real ones.
HARD, SOFT, STOP = ["of", "de", "der"], ["in", "is", "la"], ["the", "and", "que", "les"]

FLAGS = f"""
flags AS (
    SELECT rec, CASE WHEN norm IN {quoted(HARD)} THEN 'filler' ELSE 'soft_filler' END AS kind, idx, start_ms, end_ms, p_milli, norm AS detail
    FROM words WHERE norm IN {quoted(HARD + SOFT)}
    UNION ALL
    SELECT rec, 'low_conf', idx, start_ms, end_ms, p_milli, norm
    FROM (SELECT *, max(idx) OVER (PARTITION BY rec) AS last FROM words) WHERE p_milli < 450 AND norm NOT IN {quoted(STOP)} AND length(norm) >= 3 AND idx > 0 AND idx < last
    UNION ALL
    SELECT rec, 'gap', idx, start_ms - gap, start_ms, NULL, 'dead air' FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY rec ORDER BY idx) AS gap FROM words) WHERE gap > 900)
"""

KEEP = f"""
kept AS (SELECT rec, idx, start_ms, end_ms, lag(idx) OVER o AS p_idx, lag(end_ms) OVER o AS p_end FROM words WHERE norm NOT IN {quoted(HARD)} WINDOW o AS (PARTITION BY rec ORDER BY idx)),
padded AS (SELECT *, CASE WHEN idx - p_idx > 1 THEN least(30, CAST(floor(0.45 * greatest(start_ms - p_end, 0)) AS BIGINT))
                          WHEN start_ms - p_end > 600 THEN least(150, CAST(floor(0.45 * (start_ms - p_end)) AS BIGINT)) END AS pad FROM kept),
marked AS (SELECT *, sum(CASE WHEN p_idx IS NULL OR pad IS NOT NULL THEN 1 ELSE 0 END) OVER o AS island, lead(pad) OVER o AS n_pad, lead(idx) OVER o IS NULL AS last,
                  CASE WHEN p_idx IS NULL THEN greatest(0, start_ms - 250) WHEN pad IS NOT NULL THEN start_ms - pad END AS begins FROM padded WINDOW o AS (PARTITION BY rec ORDER BY idx)),
ranges AS (SELECT rec, island, max(begins) AS a, arg_max(CASE WHEN last THEN end_ms + 400 ELSE end_ms + n_pad END, idx) AS b FROM marked GROUP BY 1, 2),
keep AS (SELECT r.rec, row_number() OVER (PARTITION BY r.rec ORDER BY a, island) - 1 AS ord, a, least(b, duration) AS b
         FROM ranges r JOIN (SELECT rec, max(end_ms) AS duration FROM words GROUP BY 1) d ON d.rec = r.rec WHERE least(b, duration) - a > 20)
"""


def _flags(words: DataFrame) -> DataFrame:
    return detect.faults(words, HARD, SOFT, STOP)


def _keep(words: DataFrame) -> DataFrame:
    return plan.keep_ranges(words, words.where(t.norm(F.col("w")).isin(HARD)))


@query(f"WITH {WORDS} SELECT rec, turn, idx, w, start_ms, end_ms, p_milli FROM words")
def words_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.words(spark, sf_dir)


@query(f"""WITH {WORDS} SELECT norm, regexp_replace(lower(w), '[^a-z0-9]+', '', 'g') AS align, count(*) AS n,
           CASE WHEN length(norm) > 3 AND regexp_matches(norm, '..(''ve|''ll|''re)$') THEN left(norm, length(norm) - 3) WHEN regexp_matches(norm, '..(''d|''m|''s)$') THEN left(norm, length(norm) - 2) ELSE norm END AS repeat_key
           FROM words GROUP BY norm, align, repeat_key""")
def token_norm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return fx.words(spark, sf_dir).groupBy(t.norm(w).alias("norm"), t.align_key(w).alias("align"), t.repeat_key(w).alias("repeat_key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS} SELECT rec, idx, start_ms - gap AS start_ms, start_ms AS end_ms FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY rec ORDER BY idx) AS gap FROM words) WHERE gap > 900")
def dead_air_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dead_air(fx.words(spark, sf_dir)).select("rec", "idx", "start_ms", "end_ms")


@query(f"WITH {WORDS}, {FLAGS} SELECT * FROM flags")
def fault_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(fx.words(spark, sf_dir))


METRICS = f"""
by_kind AS (SELECT rec, count(*) FILTER (kind = 'filler') AS fillers, count(*) FILTER (kind = 'soft_filler') AS soft_fillers, count(*) FILTER (kind = 'low_conf') AS low_conf,
            count(*) FILTER (kind = 'gap') AS gap_count, coalesce(sum(end_ms - start_ms) FILTER (kind = 'gap'), 0) AS gap_ms, coalesce(max(end_ms - start_ms) FILTER (kind = 'gap'), 0) AS longest_gap_ms FROM flags GROUP BY rec),
base AS (SELECT rec, count(*) AS words, max(end_ms) - min(start_ms) AS speech_ms FROM words GROUP BY rec)
"""


@query(f"""WITH {WORDS}, {FLAGS}, {METRICS}
SELECT rec, words, speech_ms, coalesce(fillers, 0) AS fillers, coalesce(soft_fillers, 0) AS soft_fillers, coalesce(low_conf, 0) AS low_conf, coalesce(gap_count, 0) AS gap_count,
       CAST(coalesce(gap_ms, 0) AS BIGINT) AS gap_ms, coalesce(longest_gap_ms, 0) AS longest_gap_ms, CAST(floor(words * 60000 / greatest(speech_ms, 1) + 0.5) AS BIGINT) AS wpm,
       CAST(floor(coalesce(fillers, 0) * 3600000 / greatest(speech_ms, 1) + 0.5) AS BIGINT) AS fillers_per_hour, CAST(floor(1000 * coalesce(gap_ms, 0) / greatest(speech_ms, 1) + 0.5) AS BIGINT) AS gap_permille
FROM base LEFT JOIN by_kind USING (rec)""")
def recording_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir)
    return metrics.recording_metrics(words, _flags(words))


@query(f"""WITH {WORDS}, {FLAGS}, per AS (SELECT w.rec, w.rec % 4 AS class, count(*) AS words, (SELECT count(*) FROM flags f WHERE f.rec = w.rec) AS flags FROM words w GROUP BY w.rec)
SELECT class, rec, CAST(sum(words) AS BIGINT) AS words, CAST(sum(flags) AS BIGINT) AS flags FROM per GROUP BY ROLLUP (class, rec)""")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir)
    return metrics.metrics_rollup(words, _flags(words), words.select("rec", (F.col("rec") % 4).alias("class")).distinct())


@query(f"WITH {WORDS}, {KEEP} SELECT * FROM keep")
def keep_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep(fx.words(spark, sf_dir))


@query(f"""WITH {WORDS}, {KEEP}, k AS (SELECT rec, sum(b - a) AS kept_ms, count(*) AS ranges FROM keep GROUP BY rec),
p AS (SELECT w.*, CAST(coalesce(kept_ms, 0) AS BIGINT) AS kept_ms, coalesce(ranges, 0) AS ranges FROM (SELECT rec, count(*) AS words, max(end_ms) AS duration_ms FROM words GROUP BY rec) w LEFT JOIN k USING (rec)),
q AS (SELECT *, CASE WHEN kept_ms > 0 THEN CAST(floor(words * 60000 / kept_ms + 0.5) AS BIGINT) ELSE 0 END AS wpm FROM p)
SELECT *, CASE WHEN wpm > 0 THEN CAST(least(greatest(floor(145000 / wpm + 0.5), 1000), 1250) AS BIGINT) ELSE 1000 END AS tempo_permille FROM q""")
def keep_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir)
    return metrics.plan_rollup(words, _keep(words))


SEGMENTS = "segments AS (SELECT rec, turn AS seg, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words GROUP BY 1, 2)"
LOCATED = "located AS (SELECT f.*, (SELECT min(seg) FROM segments s WHERE s.rec = f.rec AND f.start_ms BETWEEN s.start_ms - 10 AND s.end_ms + 10) AS seg FROM flags f)"


@query(f"WITH {WORDS}, {FLAGS}, {SEGMENTS}, {LOCATED} SELECT rec, kind, idx, seg FROM located WHERE seg IS NOT NULL")
def fault_to_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir)
    return metrics.first_segment(_flags(words), fx.segments(words)).select("rec", "kind", "idx", "seg")


@query(f"""WITH {WORDS}, {FLAGS}, {SEGMENTS}, {LOCATED},
scored AS (SELECT rec, seg, sum(CASE kind WHEN 'filler' THEN 1.5 ELSE 1.0 END) AS score, min((start_ms, kind, idx)) AS first,
           array_to_string(list_sort(list(DISTINCT detail))[1:4], '|') AS reasons, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds
           FROM located WHERE seg IS NOT NULL AND kind IN ('filler', 'low_conf') GROUP BY rec, seg HAVING score >= 2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY rec ORDER BY score DESC, first) <= 40)
SELECT rec, seg, CAST(score AS DOUBLE) AS score, reasons, kinds, lpad(CAST(row_number() OVER (PARTITION BY rec ORDER BY start_ms, seg) AS VARCHAR), 3, '0') AS id
FROM best JOIN segments USING (rec, seg)""")
def pickups_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir)
    return metrics.pickups(_flags(words), fx.segments(words))


@query(f"""WITH {WORDS}, lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
SELECT norm, count(*) AS n FROM words WHERE norm IN (SELECT word FROM lex WHERE length(word) >= 5) GROUP BY norm""")
def dictionary_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir).select(t.norm(F.col("w")).alias("norm"))
    return words.join(_lexicon(spark, sf_dir), F.col("norm") == F.col("word"), "left_semi").groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    return fx.table(spark, sf_dir, "benchmark").select(found.alias("word")).where(F.length("word") >= 5).distinct()


@query(f"""WITH {WORDS}, lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
SELECT DISTINCT norm FROM words WHERE norm NOT IN (SELECT word FROM lex WHERE length(word) >= 5)""")
def lexicon_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir).select(t.norm(F.col("w")).alias("norm")).distinct()
    return words.join(_lexicon(spark, sf_dir), F.col("norm") == F.col("word"), "left_anti")


DOC_WORDS = """
dtok AS (SELECT doc_id AS rec, generate_subscripts(x, 1) - 1 AS idx, unnest(x) AS w FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda s: s <> '') AS x FROM documents WHERE text IS NOT NULL)),
dw AS (SELECT rec, idx, w, regexp_replace(lower(w), '[^a-z0-9'']+', '', 'g') AS n FROM dtok),
live AS (SELECT *, CASE WHEN regexp_matches(n, '..(''ve|''ll|''re)$') THEN left(n, length(n) - 3) WHEN regexp_matches(n, '..(''d|''m|''s)$') THEN left(n, length(n) - 2) ELSE n END AS key,
                row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS place FROM dw WHERE n NOT IN ('of', 'de', 'der'))
"""


def _doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, a quarter of a second apart."""
    tokens = F.array_remove(F.split("text", "[ \t\n\r]+"), "")
    rows = fx.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("rec"), F.posexplode(tokens).alias("idx", "w"))
    return rows.select("rec", F.col("idx").cast("long").alias("idx"), "w", (F.col("idx") * 250).cast("long").alias("start_ms"), (F.col("idx") * 250 + 200).cast("long").alias("end_ms"))


def _same(n: int) -> str:
    tests = [f"{lead(i)} <> '' AND {lead(i)} = {lead(n + i)}" for i in range(n)]
    near = f"lead(idx, {n}) OVER o * 250 - (lead(idx, {n - 1}) OVER o * 250 + 200) <= 600" if n > 1 else "lead(idx) OVER o * 250 - (idx * 250 + 200) <= 600"
    calm = " AND key NOT IN ('very', 'really', 'no', 'yes', 'never', 'much', 'many', 'far')" if n == 1 else ""
    return f"SELECT rec, idx, place, {n} AS n, {' AND '.join(tests)} AND {near}{calm} AS hit FROM live WINDOW o AS (PARTITION BY rec ORDER BY idx)"


def lead(i: int) -> str:
    return f"lead(key, {i}) OVER o" if i else "key"


CANDIDATES = "cand AS (" + " UNION ALL ".join(_same(n) for n in range(1, 5)) + "), hits AS (SELECT rec, idx, place, n FROM cand WHERE hit)"


@query(f"WITH {DOC_WORDS}, {CANDIDATES} SELECT rec, idx, n FROM hits")
def repeat_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.repeat_candidates(_doc_words(spark, sf_dir), hard=HARD)


@query(f"""WITH RECURSIVE {DOC_WORDS}, {CANDIDATES}, top AS (SELECT rec, place, max(n) AS n FROM hits GROUP BY 1, 2),
nexts AS (SELECT t.rec, t.place, t.n, (SELECT min(u.place) FROM top u WHERE u.rec = t.rec AND u.place >= t.place + t.n) AS following FROM top t),
walk AS (SELECT rec, place, n, following FROM nexts WHERE (rec, place) IN (SELECT (rec, min(place)) FROM top GROUP BY rec)
         UNION ALL SELECT x.rec, x.place, x.n, x.following FROM walk w JOIN nexts x ON x.rec = w.rec AND x.place = w.following),
taken AS (SELECT rec, place + i AS place FROM walk, unnest(range(n)) AS r(i))
SELECT rec, idx FROM taken JOIN live USING (rec, place)""")
def repeat_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.repeats(_doc_words(spark, sf_dir), hard=HARD)


@query()
def mangled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the whole lexicon, in alphabetical order. Sequence similarity has no SQL form; the ratio is rounded down to thousandths."""
    lexicon = _lexicon(spark, sf_dir).select(F.row_number().over(Window.orderBy("word")).alias("ord"), F.col("word").alias("term"))
    found = detect.mangled_names(fx.words(spark, sf_dir), lexicon, _lexicon(spark, sf_dir))
    return found.select("rec", "idx", "term", F.floor(F.col("ratio") * 1000).alias("permille"))


@query(
    f"""WITH RECURSIVE {WORDS},
ends AS (SELECT *, CASE WHEN regexp_matches(w, '[.!?]$') THEN 1 ELSE 0 END AS closes FROM words),
pieces AS (SELECT *, sum(closes) OVER (PARTITION BY rec ORDER BY idx) - closes AS piece FROM ends),
counts AS (SELECT rec, piece, count(*) AS n FROM pieces GROUP BY rec, piece),
run AS (SELECT rec, piece, n AS held, 0 AS chunk FROM counts WHERE piece = 0
        UNION ALL SELECT c.rec, c.piece, CASE WHEN r.held >= 3 THEN c.n ELSE r.held + c.n END, CASE WHEN r.held >= 3 THEN r.chunk + 1 ELSE r.chunk END FROM run r JOIN counts c ON c.rec = r.rec AND c.piece = r.piece + 1)
SELECT rec, CAST(chunk AS BIGINT) AS chunk, min(idx) AS first, max(idx) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(w, ' ' ORDER BY idx) AS text
FROM pieces JOIN run USING (rec, piece) GROUP BY rec, chunk HAVING count(*) >= 3 AND max(end_ms) - min(start_ms) >= 500"""
)
def sentence_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.sentence_requests(fx.words(spark, sf_dir))


@query()
def repair_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir)
    return plan.repair_spans(words, words.where(t.norm(F.col("w")).isin(HARD)))
