"""Queries over rewritten lines: edit operations, swapped words and the judge's verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import constants as C
from timeloom.functions import text as t
from timeloom.operators import rules
from timeloom.operators import sequences as seq
from timeloom.sources import fixtures as fx

from .registry import query
from .views import quoted

KEY = ["conv_id", "turn"]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as replies: every third to its forerunner, the others light edits of themselves; what was said is the forerunner, even turns are edited lines."""
    turns = fx.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(*KEY, "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("said")).where("said IS NOT NULL")
    kind = (F.col("conv_id") + F.col("turn")) % 12
    light = F.when(kind % 3 == 1, F.regexp_replace("text", "ing\\b", "ings")).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\\bthe\\b", "their"), " of ", " "), " (and|und|et|y) ", " while "))
    end = F.when(kind == 4, ",").when(kind == 5, " 7 and 12").when(kind == 7, "…").otherwise("")
    got = F.when(kind % 3 == 0, F.col("text")).when(kind == 8, "Drop.").when(kind == 10, F.lower("text")).when(kind == 11, F.concat(F.lit("Clearly "), "text")).otherwise(F.concat(light, end))
    said = t.script_tokens(F.col("said"))
    now = F.when(kind % 3 == 0, F.col("said")).otherwise(F.col("text"))
    return turns.select(*KEY, now.alias("now"), "said", got.alias("got"), ((F.col("turn") % 2 == 0) | (kind == 1)).alias("edited"), F.size(said).alias("cap"), (F.size(said) + 1).alias("budget"))


def _tokens(column: str) -> str:
    return f"coalesce(list_transform(regexp_extract_all({column}, '[A-Za-z0-9'']+'), lambda x: lower(x)), [])"


_REPLIES = """
turns AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said, (conv_id + turn) % 12 AS k FROM conversations WHERE text IS NOT NULL),
replies AS (
    SELECT conv_id, turn, CASE WHEN k % 3 = 0 THEN said ELSE text END AS now, said,
           CASE WHEN k % 3 = 0 THEN text WHEN k = 8 THEN 'Drop.' WHEN k = 10 THEN lower(text) WHEN k = 11 THEN 'Clearly ' || text ELSE
               CASE WHEN k % 3 = 1 THEN regexp_replace(text, 'ing\\b', 'ings', 'g') ELSE regexp_replace(regexp_replace(regexp_replace(text, '\\bthe\\b', 'their', 'g'), ' of ', ' ', 'g'), ' (and|und|et|y) ', ' while ', 'g') END
               || CASE k WHEN 4 THEN ',' WHEN 5 THEN ' 7 and 12' WHEN 7 THEN '…' ELSE '' END END AS got,
           turn % 2 = 0 OR k = 1 AS edited, len(regexp_extract_all(said, '[A-Za-z0-9'']+')) AS cap
    FROM turns WHERE said IS NOT NULL)
"""

_WS = "[ \\t\\n\\r]+"

# the forms of for_speech in order
_SPEECH = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(got, '[—–]', ', ', 'g'), '…|\\.\\.\\.', '.', 'g'), '[‘’]', '''', 'g'), '[“”\"]', '', 'g'), ' - ', ', ', 'g'), '{_WS}', ' ', 'g'), ' +([,.!?])', '\\1', 'g'), ', *,', ',', 'g'))"


def _blocks(name: str, source: str, key: str) -> str:
    """Relations {name}dots, {name}runs, {name}walk and {name} (key, i, j, size) of matching blocks of a source with lists a and b; recursion over cut runs."""
    part = f"PARTITION BY {key}, a0, b0, a1, b1 ORDER BY size DESC, i, j"
    return f"""
{name}dots AS (
    SELECT {key}, i, j FROM (SELECT {key}, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS x FROM {source}) JOIN (SELECT {key}, generate_subscripts(b, 1) - 1 AS j, unnest(b) AS x FROM {source}) USING ({key}, x)),
{name}runs AS (
    SELECT {key}, min(i) AS i, min(j) AS j, count(*) AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY {key}, i - j ORDER BY i) AS run FROM {name}dots) GROUP BY {key}, i - j, run),
{name}walk AS (
    SELECT {key}, i, j, size, 0::BIGINT AS a0, 0::BIGINT AS b0, 1073741824::BIGINT AS a1, 1073741824::BIGINT AS b1 FROM {name}runs
    UNION ALL
    SELECT {key}, i + late, j + late, size, a0, b0, a1, b1 FROM (
        SELECT {key}, i, j, 0::BIGINT AS late, least(size, fi - i, fj - j) AS size, a0, b0, fi AS a1, fj AS b1
        FROM (SELECT *, first(i) OVER w AS fi, first(j) OVER w AS fj FROM {name}walk WINDOW w AS ({part}))
        UNION ALL
        SELECT {key}, i, j, greatest(0, fi + fs - i, fj + fs - j) AS late, size - greatest(0, fi + fs - i, fj + fs - j) AS size, fi + fs AS a0, fj + fs AS b0, a1, b1
        FROM (SELECT *, first(i) OVER w AS fi, first(j) OVER w AS fj, first(size) OVER w AS fs FROM {name}walk WINDOW w AS ({part})))
    WHERE size > 0),
{name} AS (SELECT {key}, i, j, size FROM {name}walk QUALIFY row_number() OVER ({part}) = 1)"""


_NUMBERS = "MAP {" + ", ".join(f"{n}: '{w}'" for n, w in C.NUMBER_WORDS.items()) + "}"


@query(
    f"""WITH RECURSIVE {_REPLIES},
spoken AS (SELECT *, cap + 1 AS budget, {_SPEECH} AS new, lower(now || ' ' || said) AS spoken FROM replies),
lined AS (SELECT *, {_tokens("now")} AS a, {_tokens("new")} AS b, {_tokens("said")} AS heard,
    list_filter(regexp_extract_all(new, '[0-9]+'), lambda d: NOT contains(spoken, d) AND NOT contains(spoken, coalesce({_NUMBERS}[TRY_CAST(d AS INTEGER)], '#')))[1] AS unsaid FROM spoken),
first AS MATERIALIZED (SELECT *, CASE WHEN regexp_replace(upper(trim(got)), '\\.+$', '') = 'DROP' THEN CASE WHEN edited THEN 'none' ELSE 'drop' END
    WHEN new = '' OR trim(regexp_replace(new, '{_WS}', ' ', 'g')) = trim(regexp_replace(now, '{_WS}', ' ', 'g')) THEN 'none' WHEN regexp_matches(new, '^\\p{{Ll}}') THEN 'lowercase' WHEN regexp_matches(rtrim(new), '[,;:]$') THEN 'mid-sentence'
    WHEN unsaid IS NOT NULL THEN 'number' WHEN edited THEN CASE WHEN len(b) > len(a) + 3 THEN 'rewritten' END WHEN len(b) > len(a) AND len(b) > least(cap + 2, budget) THEN 'long' WHEN len(b) < 2 THEN 'short' ELSE 'polish' END AS why FROM lined),
pairs AS MATERIALIZED (SELECT conv_id, turn, a, b, heard FROM first WHERE edited AND (why IS NULL OR why = 'rewritten')),
{_blocks("blocks", "pairs", "conv_id, turn")},
alike AS (SELECT conv_id, turn, coalesce(sum(size), 0) AS matched, len(any_value(a)) + len(any_value(b)) AS total FROM pairs LEFT JOIN blocks USING (conv_id, turn) GROUP BY conv_id, turn),
ends AS (SELECT conv_id, turn, i, j, size FROM blocks UNION ALL SELECT conv_id, turn, len(a), len(b), 0 FROM pairs),
gaps AS (SELECT conv_id, turn, coalesce(lag(i + size) OVER w, 0) AS i0, i AS i1, coalesce(lag(j + size) OVER w, 0) AS j0, j AS j1 FROM ends WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i, j, size)),
each_word AS (SELECT conv_id, turn, pos, i1 > i0 AS replaced, CASE WHEN i0 + pos - j0 < i1 THEN a[i0 + pos - j0 + 1] END AS old, b[pos + 1] AS new FROM (SELECT *, unnest(range(j0, j1)) AS pos FROM gaps WHERE j1 > j0) JOIN pairs USING (conv_id, turn)
    WHERE b[pos + 1] NOT IN {quoted(C.SCRIPT_STOP_WORDS)} AND NOT list_contains(heard, b[pos + 1])),
words AS MATERIALIZED (SELECT DISTINCT old, new, string_split(old, '') AS a, string_split(new, '') AS b FROM each_word WHERE replaced AND old IS NOT NULL),
{_blocks("letters", "words", "old, new")},
near AS (SELECT old, new FROM words JOIN letters USING (old, new) GROUP BY old, new HAVING 20 * sum(size) >= 7 * (length(old) + length(new))),
swaps AS (SELECT conv_id, turn, min(struct_pack(pos := pos, o := coalesce(e.old, ''), n := e.new)) AS s FROM each_word e LEFT JOIN near n ON n.old = e.old AND n.new = e.new WHERE CASE WHEN replaced THEN n.new IS NULL ELSE length(e.new) > 3 END GROUP BY conv_id, turn),
last AS (SELECT f.conv_id, f.turn, coalesce(why, CASE WHEN total > 0 AND 20 * matched < 6 * total THEN 'rewritten' WHEN s IS NOT NULL THEN 'swapped' ELSE 'spruce' END) AS why, unsaid, matched, total, s
    FROM first f LEFT JOIN alike USING (conv_id, turn) LEFT JOIN swaps USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN why IN ('drop', 'spruce', 'polish') THEN why WHEN why <> 'none' THEN 'rejected' END AS kind, CASE WHEN why NOT IN ('drop', 'spruce', 'polish', 'none') THEN why END AS why,
       CASE why WHEN 'number' THEN unsaid WHEN 'rewritten' THEN CAST(CASE WHEN total = 0 THEN 1000 ELSE 2000 * matched // total END AS VARCHAR) WHEN 'swapped' THEN s.o || '>' || s.n END AS detail FROM last"""
)
def reply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(replies(spark, sf_dir), KEY)


@query(
    f"""WITH RECURSIVE {_REPLIES},
pairs AS MATERIALIZED (SELECT conv_id, turn, {_tokens("now")} AS a, {_tokens("got")} AS b FROM replies),
{_blocks("blocks", "pairs", "conv_id, turn")},
ends AS (SELECT conv_id, turn, i, j, size FROM blocks UNION ALL SELECT conv_id, turn, len(a), len(b), 0 FROM pairs),
gaps AS (SELECT conv_id, turn, coalesce(lag(i + size) OVER w, 0) AS i0, i AS i1, coalesce(lag(j + size) OVER w, 0) AS j0, j AS j1 FROM ends WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i, j, size))
SELECT conv_id, turn, CASE WHEN i1 > i0 AND j1 > j0 THEN 'replace' WHEN i1 > i0 THEN 'delete' ELSE 'insert' END AS op, i0, i1, j0, j1 FROM gaps WHERE i1 > i0 OR j1 > j0"""
)
def edit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply against its line: what is replaced, deleted and put in, as runs of words."""
    words = lambda c: F.transform(t.script_tokens(F.col(c)), F.lower).alias(c)
    pairs = seq.settled(replies(spark, sf_dir).select(*KEY, words("now"), words("got")))
    return seq.edit_operations(pairs, KEY, seq.matching_blocks(pairs, KEY, "now", "got"), "now", "got").select(*KEY, "op", *[F.col(c).cast("long").alias(c) for c in ("i0", "i1", "j0", "j1")])


#: Names that a script has to spell as they are, made of the texts' own syllables.
NAMES = ["Thandering", "Inglytion", "Ererations", "Querement", "Ungenheit", "Verkeiten", "Mentecion", "Eauxtion"]


@query(
    f"""WITH RECURSIVE w AS (SELECT DISTINCT word, lower(word) AS x FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS word FROM documents) WHERE length(word) >= 5),
n AS (SELECT name, lower(name) AS y FROM (SELECT unnest({NAMES}) AS name)),
pairs AS MATERIALIZED (SELECT word, name, string_split(x, '') AS a, string_split(y, '') AS b FROM w JOIN n ON left(x, 1) = left(y, 1) AND x <> y WHERE abs(length(x) - length(y)) <= 0.2 * (length(x) + length(y))),
{_blocks("blocks", "pairs", "word, name")}
SELECT word, name FROM pairs JOIN blocks USING (word, name) GROUP BY word, name HAVING 2 * sum(size) / (len(any_value(a)) + len(any_value(b))) >= 0.8"""
)
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that look like a misspelt name."""
    words = fx.table(spark, sf_dir, "documents").select(F.explode(t.script_tokens(F.col("text"))).alias("word"))
    return seq.near_names(words, NAMES)
