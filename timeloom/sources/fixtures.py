"""Time-aligned views over the shared test tables, in whole milliseconds.

``rec`` is the recording and partition key of every ordered operator; list positions are
explicit ordinals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters of conversations whose words, some ten times as many bytes in each sort, one task works on.
TASK_CHARS = 4_000_000


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, turn, idx, w, start_ms, end_ms, p_milli): words of the conversations with derived timings.

    Recordings are dealt to as many tasks as their texts need, so that a task's memory does not grow with the table.
    """
    turns = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    chars = turns.agg(F.sum(F.length("text"))).first()[0] or 0
    turns = turns.repartition(max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), F.col("conv_id"))
    tokens = turns.select(F.col("conv_id").alias("rec"), "turn", F.posexplode(F.split("text", "[ \t\n\r]+")).alias("pos", "w")).where("w != ''")
    order = Window.partitionBy("rec").orderBy("turn", "pos")
    n, idx = F.length("w").cast("long"), F.col("idx")
    placed = tokens.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    beat = (17 * idx + 31 * n + F.col("rec")) % 23
    gap = F.when(beat == 0, 1500).when(beat == 1, 700).otherwise(40).cast("long")
    timed = placed.withColumn("dur", 60 + 35 * n).withColumn("end_ms", F.sum(gap + F.col("dur")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # idx goes in the order of turn and pos, so one sort serves both windows
    return timed.select("rec", "turn", "idx", "w", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms", ((37 * idx + 101 * n + 13 * F.col("rec")) % 1000).alias("p_milli"))


def segments(words: DataFrame) -> DataFrame:
    """(rec, seg, start_ms, end_ms): the extent of each turn."""
    return words.groupBy("rec", F.col("turn").alias("seg")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, id, kind, a, b): an interval of half an hour to two and a half for each event."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").where("ts IS NOT NULL AND user_id IS NOT NULL").select(F.col("user_id").alias("rec"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), at.alias("a"))
    return rows.withColumn("b", F.col("a") + 1_800_000 + F.col("a") % 7_200_000)


def lines(spans: DataFrame) -> DataFrame:
    """(rec, ord, id, start, end, locked, dropped, len, hold): spans as numbered script lines."""
    return spans.select(
        "rec",
        (F.row_number().over(Window.partitionBy("rec").orderBy("a", "id")) - 1).cast("long").alias("ord"),
        "id",
        F.col("a").alias("start"),
        F.col("b").alias("end"),
        (F.col("id") % 11 == 0).alias("locked"),
        (F.col("id") % 13 == 0).alias("dropped"),
        (100 * (F.col("id") % 37)).alias("len"),
        (10 * (F.col("id") % 5)).alias("hold"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, k, v): the components of every embedding as a signal of whole thousandths."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.posexplode("embedding").alias("k", "x"))
    return rows.select("rec", F.col("k").cast("long").alias("k"), F.floor(F.col("x").cast("double") * 1000).alias("v"))


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, kind, attempt, id, score): the first three events of each user and type as attempts."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("attempt", F.row_number().over(order).cast("long")).where("attempt <= 3")
    return rows.select(F.col("user_id").alias("rec"), F.col("event_type").alias("kind"), "attempt", F.col("event_id").alias("id"), F.floor(F.col("value") * 100).alias("score"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, ord, text): sentences of the documents, numbered in each."""
    from timeloom.functions import text as t

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), F.posexplode(t.sentences(F.col("text"))).alias("ord", "text"))
    return rows.select("rec", F.col("ord").cast("long").alias("ord"), "text")


def scripted(lines: DataFrame) -> DataFrame:
    """``lines`` with texts and takes derived from their ids: audio, say, original, machine, stretch_milli, offset."""
    number = (F.col("id") % 97).cast("string")
    again = F.when(F.col("id") % 3 == 0, " again ").otherwise("")
    return lines.withColumns(
        {
            "audio": F.col("id") % 4 != 0,
            "say": F.when(F.col("id") % 2 == 0, F.concat(F.lit("Line "), number)).otherwise(F.concat(F.lit("Line  "), number, again)),
            "original": F.concat(F.lit("Line "), number),
            "machine": F.when(F.col("id") % 5 == 0, F.concat(F.lit("Line "), number, F.lit(" again"))),
            "stretch_milli": F.when(F.col("id") % 7 == 0, 900).otherwise(1000).cast("long"),
            "offset": (10 * (F.col("id") % 9)).cast("long"),
        }
    )
