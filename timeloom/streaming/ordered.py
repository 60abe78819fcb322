"""Ordered operators on Structured Streaming: an extension whose results equal the batch ones on the same rows.

Rows behind the watermark are dropped, as Structured Streaming does; state is one small
record per recording and leaves after ``idle`` without rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LONG, TEXT = T.LongType(), T.StringType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def sessions(words: DataFrame, at: str = "ts", gap: str = "600 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Runs of words (rec, at, …) without a pause of ``gap``: rec, begin, end and number of words."""
    window = F.session_window(at, gap)
    rows = words.withWatermark(at, late).groupBy("rec", window.alias("s")).agg(F.count(F.lit(1)).alias("words"))
    return rows.select("rec", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "words")


def fault_counts(flags: DataFrame, at: str = "ts", width: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Flags by recording, kind and window of time."""
    rows = flags.withWatermark(at, late).groupBy("rec", "kind", F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("flags"))
    return rows.select("rec", "kind", F.col("w.start").alias("begin"), "flags")


def dead_air(words: DataFrame, least: int = 900, idle: int = 600_000) -> DataFrame:
    """Gaps above ``least`` between words (rec, idx, start_ms, end_ms) that come in order: rec, idx, start_ms, end_ms."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("idx")
        before = rows["end_ms"].shift(1)
        if last is not None:
            before.iloc[0] = last
        found = rows[rows["start_ms"] - before > least]
        state.update((int(rows["end_ms"].iloc[-1]),))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame({"rec": found["rec"], "idx": found["idx"], "start_ms": before[found.index].astype("int64"), "end_ms": found["start_ms"]})

    out = _struct(rec=LONG, idx=LONG, start_ms=LONG, end_ms=LONG)
    rows = words.select("rec", "idx", "start_ms", "end_ms")
    return rows.groupBy("rec").applyInPandasWithState(step, out, _struct(last=LONG), "append", GroupStateTimeout.ProcessingTimeTimeout)


def changes(lines: DataFrame, idle: int = 600_000) -> DataFrame:
    """Log lines (key, n, line) without those equal to the one before them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("n")
        before = rows["line"].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((rows["line"].iloc[-1],))
        state.setTimeoutDuration(idle)
        yield rows[(rows["line"] != before)][["key", "n", "line"]]

    out = _struct(key=TEXT, n=LONG, line=TEXT)
    return lines.select("key", "n", "line").groupBy("key").applyInPandasWithState(step, out, _struct(line=TEXT), "append", GroupStateTimeout.ProcessingTimeTimeout)


def progress(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of JSON lines that are appended to a folder; lines that are no document are skipped."""
    lines = spark.readStream.text(folder).where(F.col("value").startswith("{"))
    parsed = F.from_json("value", schema)
    return lines.select(parsed.alias("row")).where("to_json(row) <> '{}'").select("row.*")


def answer(requests: DataFrame, model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Requests (id, text) with ``reply`` or ``error``; ``model`` makes the function once per task, and the id always comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply = model()
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                try:
                    rows.append((key, reply(text), None))
                except Exception as error:  # noqa: BLE001  a failed request is answered, too
                    rows.append((key, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["id", "reply", "error"])

    return requests.select("id", "text").mapInPandas(run, _struct(id=TEXT, reply=TEXT, error=TEXT))


def last_lines(lines: DataFrame, most: int = 200, idle: int = 600_000) -> DataFrame:
    """(key, n, lines): of log lines (key, n, line) the last ``most`` of each key, without those equal to the one before them, as they are after each batch.

    For update mode. State is those lines and nothing else; what is left of a key is forgotten after ``idle`` without lines.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("n")
        for line in rows["line"]:
            if not kept or kept[-1] != line:
                kept.append(line)
        kept, seen = kept[-most:], max(seen, int(rows["n"].max()))
        state.update((kept, seen))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame({"key": [key[0]], "n": [seen], "lines": [kept]})

    out = _struct(key=TEXT, n=LONG, lines=T.ArrayType(TEXT))
    held = _struct(lines=T.ArrayType(TEXT), n=LONG)
    return lines.select("key", "n", "line").groupBy("key").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.ProcessingTimeTimeout)


def append_once(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds a batch's rows to a table of progress, once however often the batch is run.

    Each batch has a folder of its own by its number, which a replay writes anew; the table is ``spark.read.parquet(folder)``, with ``batch`` as a column.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def latest_of(folder_rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key in a table of ``append_once``: that of the largest batch, then the largest n."""
    best = F.max_by(F.struct(*columns), F.struct("batch", "n"))
    return folder_rows.groupBy(*keys).agg(best.alias("last")).select(*keys, "last.*")
