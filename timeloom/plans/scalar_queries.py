"""Column functions over times, levels, texts and scores, applied to every row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import text as t
from timeloom.functions import units as u
from timeloom.operators import rank
from timeloom.sources import fixtures as fx

from .registry import query
from .views import LINES, TAKES


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.lines(fx.spans(spark, sf_dir))


@query(
    f"""WITH {LINES}, x AS (SELECT rec, id, start % 90000000 - 1000 AS raw, greatest(start % 90000000 - 1000, 0) AS x FROM lines), c AS (SELECT *, x // 10 AS c FROM x)
SELECT rec, id, CASE WHEN c >= 360000 THEN printf('%d:%02d:%02d.%02d', c // 360000, (c // 6000) % 60, (c // 100) % 60, c % 100) ELSE printf('%d:%02d.%02d', c // 6000, (c // 100) % 60, c % 100) END AS hms,
printf('%02d:%02d:%02d.%03d', x // 3600000, (x // 60000) % 60, (x // 1000) % 60, x % 1000) AS vtt, printf('%02d:%02d:%02d,%03d', x // 3600000, (x // 60000) % 60, (x // 1000) % 60, x % 1000) AS srt,
CASE id % 4 WHEN 0 THEN id % 5 * 3600 + id % 60 * 60 + 3.5 WHEN 1 THEN id % 60 * 60 + 4 WHEN 2 THEN id % 1000 END::DOUBLE AS clock, round_even(raw * 30.0::DOUBLE / 1000, 0) / 30 AS snapped FROM c"""
)
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock texts of several forms, of which one is none."""
    rows = _lines(spark, sf_dir).withColumn("x", F.col("start") % 90_000_000 - 1000)
    i = F.col("id")
    text = F.when(i % 4 == 0, F.concat((i % 5).cast("string"), F.lit(":"), (i % 60).cast("string"), F.lit(":03.5"))).when(i % 4 == 1, F.concat((i % 60).cast("string"), F.lit(":04 "))).when(i % 4 == 2, (i % 1000).cast("string")).otherwise("1:x")
    return rows.select("rec", "id", u.hms(F.col("x")).alias("hms"), u.stamp(F.col("x")).alias("vtt"), u.stamp(F.col("x"), True).alias("srt"), u.parse_clock(text).alias("clock"), u.snap(F.col("x"), 30.0).alias("snapped"))


@query(
    f"""WITH {LINES}, x AS (SELECT rec, id, len, hold, (id % 50) / 10.0::DOUBLE AS f, CASE WHEN id % 6 = 0 THEN 0 ELSE (id % 7) / 100.0 END::DOUBLE AS bed, (id % 11) / 100.0::DOUBLE AS target FROM lines),
g AS (SELECT *, pow(10.0, (6 - 4.5 * least(1.0, greatest(0.0, (len / 1000 - 0.5) / 1.5))) / 20) AS high, CASE WHEN f < 0.05 THEN 1 ELSE greatest(ceil(abs(log2(f)) - 1e-12), 1) END AS steps FROM x)
SELECT rec, id, round(12 * log2(greatest(len::DOUBLE, 1e-6) / 100), 6) AS tones, round(20 * log10(greatest(hold::DOUBLE, 1e-9)), 6) AS db,
round(CASE WHEN bed <= 0 THEN 0 WHEN target <= 0 THEN 1 ELSE least(greatest(target / bed, 1 / high), high) END, 6) AS gain, CASE WHEN id % 9 = 0 THEN 1.0 ELSE least(greatest(f, 1.0), 3.0) END::DOUBLE AS clamped,
CASE WHEN f >= 0.05 THEN CAST(steps AS INTEGER) END AS steps, CASE WHEN f >= 0.05 THEN round(pow(f, 1 / steps), 6) END AS factor, (id % 12) * 60000 / 260 AS least_ms FROM g"""
)
def level_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = _lines(spark, sf_dir).withColumns({"f": i % 50 / 10.0, "bed": F.when(i % 6 == 0, 0.0).otherwise(i % 7 / 100.0), "target": i % 11 / 100.0})
    chain = F.when(F.col("f") >= 0.05, u.tempo_chain(F.when(F.col("f") >= 0.05, F.col("f"))))
    return rows.select(
        "rec", "id",
        F.round(u.semitones(F.col("len").cast("double")), 6).alias("tones"),
        F.round(u.decibels(F.col("hold").cast("double")), 6).alias("db"),
        F.round(u.fill_gain(F.col("bed"), F.col("target"), F.col("len")), 6).alias("gain"),
        u.clamp(F.when(i % 9 == 0, float("nan")).otherwise(F.col("f")), 1.0, 3.0).alias("clamped"),
        F.when(F.col("f") >= 0.05, F.size(chain)).alias("steps"),
        F.round(F.get(chain, F.lit(0)), 6).alias("factor"),
        u.least_duration_ms(i % 12).alias("least_ms"),
    )


@query(
    f"""WITH {LINES}, n AS (SELECT rec, id, (id % 97)::VARCHAR AS n FROM lines)
SELECT rec, id, 'A, b' || n || ', c, it''s q. End, x, y' AS speech, 'my-file-' || n AS slug, 'my_file_' || n || '_.txt' AS file, n || CASE WHEN id % 2 = 0 THEN 'a' ELSE '' END AS label, left('Say: one' || n || ', two', 14) AS prompt,
CASE id % 4 WHEN 0 THEN 30000.0 / 1001 WHEN 1 THEN 25 WHEN 2 THEN 60 ELSE 60 END::DOUBLE AS rate, 'c' || n AS first, 'b' AS second,
printf('between(t,%.5f,%.5f)+between(t,%.5f,%.5f)', (id % 97) - 0.01, (id % 97) + 1 - 0.02, (id % 97) + 2 - 0.01, (id % 97) + 3 - 0.02) AS terms,
sha256('["' || n || '",""' || CASE WHEN id % 3 = 0 THEN ',"0:7"' ELSE '' END || ']') AS fingerprint FROM n"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts built from the numbers of lines, so that the wanted forms can be stated."""
    n = (F.col("id") % 97).cast("string")
    number = F.col("id") % 97 * 1000
    span = lambda a: F.struct((number + a).alias("a"), (number + a + 1000).alias("b"))
    reply = F.concat(F.lit('noise\n1. "a'), n, F.lit('"\n2) b\n 1) "c'), n, F.lit('"'))
    replies = t.numbered_replies(reply)
    rate = F.when(F.col("id") % 4 == 0, "30000/1001").when(F.col("id") % 4 == 1, "25").when(F.col("id") % 4 == 2, "x/0").otherwise("500/1")
    return _lines(spark, sf_dir).select(
        "rec", "id",
        t.for_speech(F.concat(F.lit("A — b"), n, F.lit(" - c,  it’s “q”… End , x, , y "))).alias("speech"),
        t.slug(F.concat(F.lit(" My File: "), n, F.lit("!"))).alias("slug"),
        t.safe_name(F.concat(F.lit("C:\\dir/my file "), n, F.lit(" .txt"))).alias("file"),
        t.block_label(F.concat(F.lit("s0"), n, F.when(F.col("id") % 2 == 0, "a").otherwise(""))).alias("label"),
        t.prompt(F.array(F.concat(F.lit("one"), n), F.lit("two")), "Say: ", 14).alias("prompt"),
        u.frame_rate(rate).alias("rate"),
        F.element_at(replies, 1).alias("first"), F.element_at(replies, 2).alias("second"),
        u.between_terms(F.array(span(0), span(2000)), 25.0).alias("terms"),
        u.fingerprint([n, F.lit(None).cast("string")], [(F.when(F.col("id") % 3 == 0, 7).otherwise(5), "5")]).alias("fingerprint"),
    )


@query(
    f"""WITH {TAKES}, t AS (SELECT rec, kind, attempt, score, id % 7 AS clicks, 100 + id % 90 AS pace, (id % 13) / 4.0::DOUBLE AS sd, CASE WHEN id % 3 <> 0 THEN (id % 5) / 2.0 END::DOUBLE AS pitch FROM takes)
SELECT rec, kind, attempt, round(0.3 * clicks + 0.25 * abs(pace - 145) + 0.3 * sd + 4 * coalesce(pitch, 3) + 2 * sd, 6) AS candidate,
round(10 * (clicks + 1) + 0.6 * coalesce(nullif(pitch, 0), 20) + 0.4 * coalesce(nullif(sd, 0), 10) + 0.05 * coalesce(nullif(sd, 0), 40), 6) AS checkpoint FROM t"""
)
def score_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = fx.takes(spark, sf_dir).withColumns({"clicks": i % 7, "pace": 100 + i % 90, "sd": i % 13 / 4.0, "pitch": F.when(i % 3 != 0, i % 5 / 2.0)})
    candidate = rank.candidate_score(F.col("clicks"), F.col("pace"), F.col("sd"), F.col("pitch"), F.col("sd"))
    checkpoint = rank.checkpoint_score(F.col("clicks"), F.lit(1), F.col("pitch"), F.col("sd"), F.col("sd"))
    return rows.select("rec", "kind", "attempt", F.round(candidate, 6).alias("candidate"), F.round(checkpoint, 6).alias("checkpoint"))
