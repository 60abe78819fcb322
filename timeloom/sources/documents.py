"""Readers and writers of transcripts, word lists, logs, manifests, subtitles and sound."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = "struct<word:string,text:string,start:double,end:double,probability:double,confidence:double>"
TRANSCRIPT = f"segments array<struct<start:double,end:double,text:string,words:array<{_WORD}>>>, source string"


def finite(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Words (rec, idx, w, start_ms, end_ms, p_milli) and segments of nested transcript documents, one per file.

    Both names of a word's text and of its confidence are read; a missing confidence is 1,
    and words without text go. ``rec`` is the file.
    """
    raw = spark.read.schema(TRANSCRIPT).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("rec"), F.posexplode("segments").alias("seg", "s"))
    ms = lambda c: F.floor(c * 1000 + 0.5)
    segments = raw.select("rec", "seg", ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"), F.trim("s.text").alias("text"))
    words = raw.select("rec", "seg", F.posexplode("s.words").alias("pos", "x"))
    words = words.select("rec", "seg", "pos", F.trim(F.coalesce("x.word", "x.text")).alias("w"), ms(F.col("x.start")).alias("start_ms"), ms(F.col("x.end")).alias("end_ms"), ms(F.coalesce("x.probability", "x.confidence", F.lit(1.0))).alias("p_milli")).where("w <> ''")
    idx = (F.row_number().over(Window.partitionBy("rec").orderBy("seg", "pos")) - 1).cast("long")
    return words.select("rec", idx.alias("idx"), "w", "start_ms", "end_ms", "p_milli"), segments


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): lines without blanks around them, empty ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> '' AND NOT startswith(term, '#')")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def manifest(spark: SparkSession, path: str, schema: str = "audio string, text string, seconds double, passage int, source string") -> DataFrame:
    """JSON lines with a text; lines that are no document, such as one half written, go."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("text IS NOT NULL AND text <> ''")


def clip_keys(paths: DataFrame, column: str = "audio") -> DataFrame:
    """Adds passage and sentence of names such as read_p001s02.wav; null where a name has none."""
    part = lambda i: F.regexp_extract(column, r"_p(\d+)s(\d+)\.\w+$", i).try_cast("int")
    return paths.withColumn("passage", part(1)).withColumn("sentence", part(2))


def carry_forward(lines: DataFrame, key: str, order: str, text: str, section: str) -> DataFrame:
    """Lines with ``section``: what the pattern's first group last matched at or before them."""
    found = F.nullif(F.regexp_extract(text, section, 1), F.lit(""))
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(found, ignorenulls=True).over(whole))


def last_values(lines: DataFrame, key: str, order: str, text: str, names: list[str]) -> DataFrame:
    """(key, name, value): the last number given to each name in lines such as ``RMS level: -20.1``."""
    pattern = rf"({'|'.join(names)}):?\s+(-?\d+(?:\.\d+)?)"
    rows = lines.select(key, order, F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).try_cast("double").alias("value")).where("name <> ''")
    return rows.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))


def last_json(text: Column, schema: str) -> Column:
    """The last flat JSON object in a log."""
    return F.from_json(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1), F.lit(-1)), schema)


def reply_passages(reply: Column, least_words: int = 15) -> Column:
    """Texts of the JSON array in a reply, without those of too few words."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<string>")
    return F.filter(found, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least_words)


def relocate(text: Column, moves: dict[str, str]) -> Column:
    """Text with path prefixes replaced, as literals."""
    for old, new in moves.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def missing_files(paths: DataFrame, listing: DataFrame) -> DataFrame:
    return paths.join(listing, "path", "left_anti")


def subtitles(cues: DataFrame, srt: bool = False) -> DataFrame:
    """(rec, body): the subtitle file of each recording from its cues (rec, a, b, text) in order of time."""
    from timeloom.functions.units import stamp

    times = F.concat(stamp(F.col("a"), srt), F.lit(" --> "), stamp(F.col("b"), srt), F.lit("\n"), F.col("text"))
    block = F.concat((F.row_number().over(Window.partitionBy("rec").orderBy("a", "b")).cast("string")), F.lit("\n"), times) if srt else times
    rows = cues.select("rec", "a", "b", block.alias("block")).groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    return rows.select("rec", F.concat(F.lit("" if srt else "WEBVTT\n\n"), "body", F.lit("\n")).alias("body"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def snapshot(rows: DataFrame, folder: str, version: int) -> str:
    """Writes a new version of a table beside the old ones, which stay readable until they are removed."""
    path = f"{folder}/v{version:08d}"
    rows.write.parquet(path)
    return path


SOUND = T.StructType([T.StructField("path", T.StringType()), T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


def sounds(spark: SparkSession, path: str, mono: bool = True, block: int = 480_000) -> DataFrame:
    """16-bit PCM WAV files in blocks of samples, mixed down or interleaved; values from -1 to 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as f:
                    rate, channels = f.getframerate(), f.getnchannels()
                    values = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / 32768
                if mono and channels > 1:
                    values = values[: len(values) // channels * channels].reshape(-1, channels).mean(axis=1)
                for nth, at in enumerate(range(0, len(values), block)):
                    yield pd.DataFrame({"path": [name], "rate": rate, "channels": 1 if mono else channels, "block": nth, "samples": [values[at : at + block]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(run, SOUND)


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """A mono 16-bit WAV file of each row; louder than full scale is scaled down, not clipped."""
    out = []
    for values, hz in zip(samples, rate, strict=True):
        x = np.asarray(values, np.float32)
        x = x / max(1.0, float(np.abs(x).max(initial=0)))
        data = np.round(x * 32767).astype("<i2").tobytes()
        out.append(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, hz, 2 * hz, 2, 16) + b"data" + struct.pack("<I", len(data)) + data)
    return pd.Series(out)


def resample(samples: Column, rate: Column, to: int = 16_000) -> Column:
    """Linear interpolation of each row's samples to another rate."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(values: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([np.interp(np.arange(0, len(v), r / to), np.arange(len(v)), v).astype(np.float32) if len(v) else v for v, r in zip(values, rates, strict=True)])

    return run(samples, rate)


def main_stream(probe: Column) -> Column:
    """The first video stream of a probe's JSON that is no thumbnail (an attached picture, or a still image format), as (codec, width, height, rate text)."""
    schema = "streams array<struct<codec_type: string, codec_name: string, width: long, height: long, r_frame_rate: string, disposition: struct<attached_pic: int>>>"
    streams = F.from_json(probe, schema)["streams"]
    still = lambda s: (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 1) | F.coalesce(s["codec_name"].isin("mjpeg", "png"), F.lit(False))
    found = F.get(F.filter(streams, lambda s: (s["codec_type"] == "video") & ~still(s)), F.lit(0))
    return F.struct(found["codec_name"].alias("codec"), found["width"].alias("width"), found["height"].alias("height"), found["r_frame_rate"].alias("rate"))


def projects(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON documents of a folder, one a file, newest ``createdAt`` first; files that are no document are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder, multiLine=True)
    kept = [c for c in rows.columns if c != "_corrupt"]
    return rows.select(*kept, "_corrupt").where("_corrupt IS NULL").select(*kept).orderBy(F.desc("createdAt"))


def checkpoints(paths: DataFrame, path: str = "path") -> DataFrame:
    """(run, step) of a listing of files ``…/<run>/step_<n>/<name>``, those whose folder has a configuration, with the run's ``newest``."""
    parts = r"(?:^|/)([^/]+)/step_(\d+)/([^/]+)$"
    rows = paths.select(F.regexp_extract(path, parts, 1).alias("run"), F.regexp_extract(path, parts, 2).alias("step"), F.regexp_extract(path, parts, 3).alias("name")).where("run <> '' AND name = 'config.json'")
    rows = rows.select("run", F.col("step").cast("long").alias("step")).distinct()
    return rows.join(rows.groupBy("run").agg(F.max("step").alias("newest")), "run")


def suggestion_documents(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """(key, suggested, rejected, unanswered, document): one JSON document for each key of verdicts (key, n, kind, why, text), lists in the order of n.

    A verdict without kind is unanswered if it has no text either. Each key's verdicts are one document, as a reader takes it.
    """
    picked = lambda test, *columns: F.array_sort(F.collect_list(F.when(test, F.struct("n", *columns))))
    kind = F.col("kind")
    good, bad, none = kind.isNotNull() & (kind != "rejected"), F.coalesce(kind == "rejected", F.lit(False)), kind.isNull() & F.col("text").isNull()
    rows = verdicts.groupBy(*key).agg(picked(good, "kind", "text").alias("suggestions"), picked(bad, "why").alias("rejected_lines"), F.array_sort(F.collect_list(F.when(none, F.col("n")))).alias("unanswered_lines"))
    return rows.select(*key, F.size("suggestions").alias("suggested"), F.size("rejected_lines").alias("rejected"), F.size("unanswered_lines").alias("unanswered"), F.to_json(F.struct("suggestions", "rejected_lines", "unanswered_lines")).alias("document"))


def write_lexicon(terms: DataFrame, folder: str, header: str = "# one term a line") -> None:
    """Distinct terms (place, term) as text lines in the order of their places, a comment first; the first spelling of a term stays."""
    first = terms.where("trim(term) <> ''").groupBy(F.lower(F.trim("term")).alias("_t")).agg(F.min(F.struct("place", F.trim("term").alias("term"))).alias("f"))
    lines = first.select("f.place", "f.term").unionByName(terms.sparkSession.createDataFrame([(-1, header)], "place long, term string").withColumn("place", F.col("place").cast(terms.schema["place"].dataType)))
    lines.repartitionByRange("place").sortWithinPartitions("place").select("term").write.mode("overwrite").text(folder)
