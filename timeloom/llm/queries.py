"""The registered queries of the ten operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, embedding_dedup, jaccard, language_id, license_scan, line_dedup, packing, quality, quality_rules, spelling, url_filter, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archive(read(spark, sf_dir, "pages"))
    page = lambda c: F.expr(f"try_cast({c} AS long)")
    return index.select(page("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: The rules that the query applies, in the order host, path, verdict.
RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rule`` is host and path of the fitting rule, such as ``net/de/``."""
    found = url_filter.judge(read(spark, sf_dir, "pages"), RULES, ["page_id"])
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), least_words=1)
    return done.select("doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, model, ["doc_id"])
    return found.select("doc_id", (language_id.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (language_id.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), size=4, percent=85)


def op11_conversation_trie(spark: SparkSession, sf_dir: str, **sizes: int) -> DataFrame:
    turns = conversation_trie.numbered(read(spark, sf_dir, "conversations"))
    return conversation_trie.trie(*conversation_trie.headed(turns, 20, F.crc32(F.col("conv").cast("string").cast("binary")) % 4), **sizes)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 31st run by its hash loses a letter. A null doc_id counts as empty."""
    found = spelling.runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.length("word")).cast("int")
    slipped = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return spelling.variants(spelling.counted(found.select(F.when(h % 31 == 0, slipped).otherwise(F.col("word")).alias("word"))))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_warc": op3_warc,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_spelling": op13_spelling,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(ws)) AS size, array_to_string(ws[i + 1:i + least(10, len(ws))], ' ') AS phrase
    FROM items, unnest(range(greatest(len(ws) - 9, 1))) AS r(i) WHERE len(ws) > 0),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
places AS (
    SELECT doc_id, size, i, array_to_string(ws[i + 1:i + size], ' ') AS phrase
    FROM docs, (SELECT DISTINCT size FROM windows) AS sizes, unnest(range(greatest(len(ws) - size + 1, 0))) AS r(i)),
found AS (SELECT doc_id, i, size, item FROM places JOIN windows USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(size)) AS r(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op9_jaccard_join"] = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS shingle
    FROM docs, unnest(range(greatest(len(ws) - 3, 1))) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * m >= 85 * (s.n + t.n - m)),
ends AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN ends e ON r.y = e.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id)
"""

ORACLES["op2_embedding_dedup"] = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS size,
           label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS sound
    FROM embeddings),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.sound AND b.sound AND a.size > 0 AND b.size > 0 AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts c ON c.x = vec_id JOIN least l ON l.x = vec_id
"""

# base32 digits are five bits each: five hexadecimal digits hold four of them
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, {5 * g + 1}, 5) AS INTEGER) >> {15 - 5 * j}) & 31) + 1, 1)" for g in range(8) for j in range(4))

ORACLES["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


def _license_oracle() -> str:
    templates = ", ".join(f"({i}, '{label}', '{notice}')" for i, (label, notice) in enumerate(license_scan.TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i AS start FROM d, unnest(range(greatest(len(ws) - {len(p) - 1}, 0))) AS r(i) WHERE ws[i + 1:i + {len(p)}] = [{', '.join(repr(w) for w in p)}]" for label, p in license_scan.PHRASES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
places AS ({phrases}),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id),
templates(template, label, notice) AS (VALUES {templates}),
tw AS (SELECT *, string_split(notice, ' ') AS words FROM templates),
tg AS (SELECT template, i AS place, array_to_string(words[i + 1:i + 3], ' ') AS gram FROM tw, unnest(range(len(words) - 2)) AS r(i)),
dg AS (SELECT doc_id, i AS here, array_to_string(ws[i + 1:i + 3], ' ') AS gram FROM d, unnest(range(greatest(len(ws) - 2, 0))) AS r(i)),
votes AS (SELECT doc_id, template, here - place AS diagonal, min(here) AS f, max(here) AS l, list(DISTINCT place) AS p FROM dg JOIN tg USING (gram) GROUP BY 1, 2, 3),
far AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 3 THEN 0 ELSE 1 END AS fresh FROM votes WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM far),
merged AS (SELECT doc_id, template, min(f) AS f, max(l) + 3 AS l, list_distinct(flatten(list(p))) AS p FROM islands GROUP BY doc_id, template, island),
spans AS (SELECT doc_id, label, notice, ws, len(words) AS many, greatest(f - list_min(p), 0) AS a, l FROM merged JOIN tw USING (template) JOIN d USING (doc_id) WHERE len(p) >= 0.5 * (len(words) - 2)),
bodies AS (SELECT doc_id, label, notice, array_to_string(ws[a + 1:a + least(greatest(l - a, least(many, len(ws) - a)), many + 3)], ' ') AS body FROM spans),
alike AS (SELECT doc_id, label, 1 - levenshtein(body, notice) / greatest(length(body), length(notice)) AS likeness FROM bodies),
found AS (SELECT doc_id, max(likeness) AS likeness, list(DISTINCT label) AS labels FROM alike WHERE likeness >= 0.9 GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(b.labels, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(likeness, 0)::DOUBLE END AS score
FROM d LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


ORACLES["op5_license_scan"] = _license_oracle()

# crc32 byte by byte, from a table that its rule gives
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc(bytes_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_list}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


# all characters are below U+0100, so two bytes at most
_BYTES = "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))"

ORACLES["op13_spelling"] = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
runs AS MATERIALIZED (
    SELECT id, w, count(*) AS m
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
    WHERE length(w) >= 7 GROUP BY ALL),
hashed AS MATERIALIZED (SELECT w, m, {_crc(_BYTES.format("id || ':' || w"))} AS h FROM runs, crc),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, m FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cut AS MATERIALIZED (SELECT DISTINCT word, n, i, word[:i] || '*' || word[i + 2:] AS skipped, word[:i] || word[i + 2:] AS less FROM words, unnest(range(length(word))) AS r(i)),
pairs AS (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.skipped = b.skipped AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words LEFT JOIN near USING (word)),
walk AS (SELECT word, form AS here FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.here = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.here AS root FROM walk w JOIN forms f ON w.here = f.word WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""

ORACLES["op11_conversation_trie"] = f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
turns AS MATERIALIZED (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS leader, {_crc(_BYTES.format("CAST(conv_id AS VARCHAR)"))} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
mixed AS (
    SELECT c.conv_id, t.place, 0 AS own, role, text FROM convs c JOIN turns t ON t.conv_id = c.leader AND t.place < c.h
    UNION ALL SELECT c.conv_id, t.place, 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
prints AS (
    SELECT conv_id, row_number() OVER w AS depth, sha256(concat(length(role), ' ', role, text)) AS print, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM mixed WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
paths AS MATERIALIZED (
    SELECT conv_id, depth, words, sha256(string_agg(print, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM prints
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY conv_id),
nodes AS MATERIALIZED (
    SELECT node, depth, max(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth) AS ends
    FROM paths JOIN sizes USING (conv_id) GROUP BY node, depth),
ups AS MATERIALIZED (SELECT n.node, n.conv_id, n.depth, n.words, n.n_convs, p.node AS up FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS MATERIALIZED (SELECT up AS node, count(*) AS n_children FROM ups WHERE up IS NOT NULL GROUP BY up),
below AS (
    SELECT p.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved
    FROM ups u LEFT JOIN kids k USING (node) JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN ups u USING (node) LEFT JOIN nodes p ON p.node = u.up LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node
"""
