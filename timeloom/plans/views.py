"""DuckDB forms of the fixture views, to put before an oracle."""

WORDS = """
tok AS (SELECT conv_id AS rec, turn, generate_subscripts(x, 1) AS pos, unnest(x) AS w
        FROM (SELECT conv_id, turn, string_split_regex(text, '[ \\t\\n\\r]+') AS x FROM conversations WHERE text IS NOT NULL)),
num AS (SELECT rec, turn, w, length(w) AS n, row_number() OVER (PARTITION BY rec ORDER BY turn, pos) - 1 AS idx FROM tok WHERE w <> ''),
beat AS (SELECT *, 60 + 35 * n AS dur, (17 * idx + 31 * n + rec) % 23 AS m FROM num),
timed AS (SELECT *, sum(dur + CASE m WHEN 0 THEN 1500 WHEN 1 THEN 700 ELSE 40 END) OVER (PARTITION BY rec ORDER BY idx) AS e FROM beat),
words AS (SELECT rec, turn, idx, w, CAST(e - dur AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, (37 * idx + 101 * n + 13 * rec) % 1000 AS p_milli,
                 regexp_replace(lower(w), '[^a-z0-9'']+', '', 'g') AS norm FROM timed)
"""

SPANS = """
stamps AS (SELECT user_id AS rec, event_id AS id, event_type AS kind, epoch_us(ts) // 1000 AS a FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
spans AS (SELECT rec, id, kind, a, a + 1800000 + a % 7200000 AS b FROM stamps)
"""

LINES = SPANS + """,
lines AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY a, id) - 1 AS ord, id, a AS start, b AS "end", id % 11 = 0 AS locked, id % 13 = 0 AS dropped,
                 100 * (id % 37) AS len, 10 * (id % 5) AS hold FROM spans)
"""

FRAMES = """
frames AS (SELECT vec_id AS rec, generate_subscripts(embedding, 1) - 1 AS k, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings)
"""

TAKES = """
takes AS (SELECT user_id AS rec, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt, event_id AS id,
                 CAST(floor(value * 100) AS BIGINT) AS score FROM events QUALIFY attempt <= 3)
"""


def union(source: str, name: str = "u") -> str:
    """Islands of a relation with rec, a and b."""
    return f"""
{name}1 AS (SELECT rec, a, b, max(b) OVER (PARTITION BY rec ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM {source} WHERE b > a),
{name}2 AS (SELECT rec, a, b, sum(CASE WHEN a <= f THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY a, b ROWS UNBOUNDED PRECEDING) - 1 AS island FROM {name}1),
{name} AS (SELECT rec, CAST(island AS BIGINT) AS island, min(a) AS a, max(b) AS b FROM {name}2 GROUP BY 1, 2)
"""


def quoted(items: list[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


SCRIPTED = LINES + """,
scripted AS (SELECT *, id % 4 <> 0 AS audio,
                    CASE WHEN id % 2 = 0 THEN 'Line ' || (id % 97) ELSE 'Line  ' || (id % 97) || CASE WHEN id % 3 = 0 THEN ' again ' ELSE '' END END AS say,
                    'Line ' || (id % 97) AS original, CASE WHEN id % 5 = 0 THEN 'Line ' || (id % 97) || ' again' END AS machine,
                    CASE WHEN id % 7 = 0 THEN 900 ELSE 1000 END AS stretch_milli, 10 * (id % 9) AS "offset" FROM lines)
"""


def squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


#: crc32's table by its rule, as a list ``t``, and the sum of a string of ASCII characters from it.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
