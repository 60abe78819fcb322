"""Queries over script text, examples, pages and event documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import text as t
from timeloom.functions.constants import FILLER_PHRASES, SCRIPT_STOP_WORDS
from timeloom.operators import align, rank, rules
from timeloom.sources import documents as docs
from timeloom.sources import fixtures as fx

from .registry import query
from .views import quoted

# sentences without look-behind: a mark behind . ! or ? and a blank, then a split at the mark
SENTENCES = """
sent AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS ord, text FROM (
    SELECT doc_id AS rec, generate_subscripts(x, 1) AS pos, unnest(x) AS text FROM (
        SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL)) WHERE text <> '')
"""


@query(f"WITH {SENTENCES} SELECT rec, ord, text, regexp_matches(rtrim(text), '[.!]$') AS statement, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n_words FROM sent")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return fx.sentences(spark, sf_dir).select("rec", "ord", "text", t.statement_end(text).alias("statement"), t.word_count(text).alias("n_words"))


#: The fixed phrases and one that the test texts have.
PHRASES = [*FILLER_PHRASES, "of the"]


def _checks_sql() -> str:
    phrases = ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b{p}\\b') THEN 'filler:{p}' END" for p in (x.replace("'", "''") for x in PHRASES))
    one_of = rules.ONE_OF.replace("'", "''")
    return f"""WITH {SENTENCES}, o AS (SELECT *, regexp_extract(regexp_extract(lower(text), '{one_of}', 1), '([a-z-]+)$', 1) AS last FROM sent), m AS (SELECT rec, ord, list_filter([
    CASE WHEN regexp_matches(text, '\\bword (document|doc|file|format)') THEN 'word-format' END, {phrases},
    CASE WHEN regexp_matches(text, '[A-Za-z]\\.\\s+[a-z]') THEN 'stop-inside' END, CASE WHEN regexp_matches(text, '^\\p{{Ll}}') THEN 'lower-start' END,
    CASE WHEN regexp_matches(text, ',\\s*\\w+,\\s') AND regexp_matches(text, '^\\W*\\w+,\\s*\\w+,') THEN 'comma-pair' END,
    CASE WHEN last <> '' AND last NOT IN {quoted(SCRIPT_STOP_WORDS)} AND NOT ends_with(last, 's') THEN 'singular' END, CASE WHEN regexp_matches(text, '\\s{{2,}}') THEN 'double-space' END,
    CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9'']+')) > 20 THEN 'too-long' END], lambda x: x IS NOT NULL) AS notes FROM o)
SELECT rec, ord, array_to_string(notes, '|') AS notes FROM m WHERE len(notes) > 0"""


@query(_checks_sql())
def script_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of rules; they are evaluated below the filter once, behind an explode."""
    found = F.array_join(rules.notes(F.col("text"), F.lit(20), phrases=PHRASES), "|")
    return fx.sentences(spark, sf_dir).select("rec", "ord", F.explode(F.array(found)).alias("notes")).where("notes <> ''")


@query(f"""WITH {SENTENCES}, p AS (SELECT rec, ord, text, lead(text) OVER (PARTITION BY rec ORDER BY ord) AS after FROM sent),
s AS (SELECT *, len(regexp_extract_all(after, '[^ \\t\\n\\r]+')) / greatest(1, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))) AS share FROM p WHERE after IS NOT NULL)
SELECT rec, ord, CASE WHEN trim(after) = '' THEN 'rejected' WHEN share NOT BETWEEN 0.55 AND 1.6 THEN 'rejected' WHEN after = text THEN 'kept' ELSE 'changed' END AS verdict FROM s""")
def clean_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence judged as if the one behind it were its rewrite."""
    pairs = fx.sentences(spark, sf_dir).withColumn("after", F.lead("text").over(Window.partitionBy("rec").orderBy("ord"))).where("after IS NOT NULL")
    return pairs.select("rec", "ord", rules.clean_verdict(F.col("text"), F.col("after")).alias("verdict"))


def _content(column: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '[A-Za-z0-9'']+'), lambda x: lower(x)), lambda x: length(x) > 3 AND x NOT IN ('that', 'with'))"


_SCORE = "shared / (sqrt(size) + 1) + 0.4::DOUBLE * greatest(0.0::DOUBLE, 1 - final_words / greatest(1, said_words))"


@query(
    f"""WITH w AS (SELECT DISTINCT item_id, unnest({_content("text")}) AS word FROM benchmark), items AS (SELECT DISTINCT item_id FROM benchmark),
b AS (SELECT doc_id, source, text AS said, regexp_replace(text, ' (the|of|and|der|die|und|de|la|et|que|y) ', ' ', 'g') AS final FROM documents),
k AS (SELECT doc_id, source, list_distinct(list_concat({_content("said")}, {_content("final")})) AS known, len(regexp_extract_all(coalesce(said, ''), '[A-Za-z0-9'']+')) AS said_words, len(regexp_extract_all(coalesce(final, ''), '[A-Za-z0-9'']+')) AS final_words FROM b),
f AS (SELECT doc_id, source, len(known) AS size, said_words, final_words, known FROM k WHERE len(known) > 0),
m AS (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT doc_id, unnest(known) AS word FROM f) JOIN w USING (word) GROUP BY ALL),
s AS (SELECT item_id, source, f.doc_id, {_SCORE.replace("shared", "coalesce(shared, 0)")} AS score FROM items CROSS JOIN f LEFT JOIN m USING (item_id, doc_id)),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) <= 4)
SELECT item_id, source, doc_id, CAST(floor(score * 1000000) AS BIGINT) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM c QUALIFY place <= 14"""
)
def example_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the fourteen best of all documents, four of one source at most; what a document was shortened to is its text without small words."""
    bank = fx.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("said"), F.regexp_replace("text", " (the|of|and|der|die|und|de|la|et|que|y) ", " ").alias("final"))
    found = rank.best_examples(fx.table(spark, sf_dir, "benchmark").select("item_id", "text"), bank, ["that", "with"])
    return found.select("item_id", "source", "doc_id", F.floor(F.col("score") * 1_000_000).alias("score"), "place")


@query()
def example_retrieval_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen best examples for every benchmark item, from the whole texts of all documents.

    The squared overlap for an example's size, in whole numbers, without what was shortened.
    """
    return rank.pick_examples(fx.table(spark, sf_dir, "benchmark").select("item_id", "text"), fx.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["that", "with"])


@query("SELECT left(text, 60) AS opening, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedupe_prefix60(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.groupBy(F.substring("text", 1, 60).alias("opening")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="[^"]*"')) AS links,
length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text_chars FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    body = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \t\n\r]+", " ")
    links = F.size(F.regexp_extract_all(html, F.lit('(<a href="[^"]*")'), 1)).cast("long")
    return fx.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), links.alias("links"), F.length(body).cast("long").alias("text_chars"))


@query("""WITH l AS (SELECT page_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT page_id, string_split(replace(html, '>', '>' || chr(10)), chr(10)) AS x FROM pages)),
c AS (SELECT *, last_value(nullif(regexp_extract(line, '^<(h1|p|li|div|nav|article)( |>)', 1), '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM l)
SELECT page_id, section, count(*) AS lines FROM c GROUP BY 1, 2""")
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page, each under the last section tag before it: a section carried forward."""
    lines = fx.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.replace("html", F.lit(">"), F.lit(">\n")), "\n")).alias("pos", "line"))
    return docs.carry_forward(lines, "page_id", "pos", "line", "^<(h1|p|li|div|nav|article)( |>)").groupBy("page_id", "section").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k DOUBLE")["k"]
    return fx.table(spark, sf_dir, "events").groupBy("event_type", docs.finite(k).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query()
def seq_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words, of seven letters or more, of the benchmark that are nearly another of its own or one of the documents'."""
    from timeloom.operators.detect import near_words

    def long_words(name: str) -> DataFrame:
        found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)))
        return fx.table(spark, sf_dir, name).select(found.alias("word")).where("length(word) >= 7").distinct()

    wanted = long_words("benchmark")
    pairs = near_words(wanted, wanted.unionByName(long_words("documents")), 0.6)
    return pairs.select("a", "b", F.floor(F.col("ratio") * 1000).alias("permille"))


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of the conversations against the one before it."""
    turns = fx.table(spark, sf_dir, "conversations").withColumn("old", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("old IS NOT NULL")
    return turns.select("conv_id", "turn", F.to_json(align.word_diff("old", "text")).alias("diff"))


@query()
def take_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as wanted text, heard without their last word."""
    rows = fx.table(spark, sf_dir, "benchmark").select("item_id", "text", F.regexp_replace("text", "[ \n][^ \n]+$", "").alias("heard"))
    return rows.select("item_id", align.compare_takes("text", "heard").alias("v")).select("item_id", "v.ok", "v.missing_head", "v.missing_tail", "v.inserted", "v.trailing", F.floor(F.col("v.score") * 1000).alias("permille"))


@query()
def unit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as script units, located in the words of their conversation."""
    units = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").cast("long").alias("unit"), "text")
    return align.align_units(units, fx.words(spark, sf_dir))
