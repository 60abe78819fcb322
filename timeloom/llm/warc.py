"""WARC archives with revisit records, and a capture index merged from locally sorted runs."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, TEXT, fields, new_path, written

#: Payload bytes that one archive file holds, about.
ARCHIVE_BYTES = 8_000_000

#: Bytes of a record beside its payload, about.
HEAD_BYTES = 500

#: Payloads with copies that are broadcast at most (about 60 bytes each); more are joined by a shuffle of all pages.
BROADCAST_ROWS = 500_000

#: Index lines in one part of the merged index, about.
PART_LINES = 20_000

INDEX = T.StructType(
    fields(url_key=TEXT, captured=TEXT, page_id=TEXT, url=TEXT, record_type=TEXT, payload_bytes=LONG, payload_digest=TEXT, refers_to=TEXT, archive=TEXT, offset=LONG, length=LONG)
)


def records(pages: DataFrame, page_id: str, url: str, payload: str, captured=None, least_bytes: int = 0) -> DataFrame:
    """One WARC record per page as text: page_id, size and record (without its last line end).

    The payload is the UTF-8 text, empty for null. Of pages with equal payloads of at least
    ``least_bytes`` bytes the one with the smallest id is the response and the others refer to
    it; smaller payloads are all responses. Rows that repeat the smallest id are responses
    too; a null id comes before all others. ``captured`` is a timestamp column (null or
    none: 1970). A null url is written as an empty target; line ends in a url are escaped.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    stamp = F.coalesce(captured, F.timestamp_seconds(F.lit(0))) if captured is not None else F.timestamp_seconds(F.lit(0))
    target = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page"),
        target.alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("size"),
        F.sha1(F.encode(body, "UTF-8")).alias("digest"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
    )
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min(F.struct(F.col("page").isNotNull().alias("known"), F.col("page").alias("first"))).alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    first = written(first, "responses")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = rows.join(first, ["digest", "size"], "left")
    again = F.col("least").isNotNull() & ~F.col("page").eqNullSafe(F.col("least.first"))
    line = "\r\n"
    uri = lambda column: F.concat(F.lit("urn:page:"), F.coalesce(column.cast("string"), F.lit("")))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <"),
        uri(F.col("page")),
        F.lit(f">{line}WARC-Date: "),
        F.col("stamp"),
        F.lit(f"{line}WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(again, F.concat(F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <"), uri(F.col("least.first")), F.lit(f">{line}WARC-Payload-Length: "), F.col("size"))).otherwise(""),
        F.lit(f"{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
        F.when(again, 0).otherwise(F.col("size")).cast("string"),
        F.lit(line + line),
    )
    return rows.select("page", "size", F.concat(head, F.when(again, "").otherwise(F.col("body")), F.lit(line)).alias("record"))


def write_archives(rows: DataFrame, path: str, mean_bytes: float, largest: int) -> None:
    """Writes ``records`` as archive files: text files whose line end closes a record.

    Payloads are written by classes of size, up to twice the mean and then 16 times as large
    each, with as many records to a file as keep it within about ARCHIVE_BYTES if all are the largest of
    their class; only a larger payload makes a larger file, alone. Each task writes what it has read; no page moves.
    """
    low, high, nth = -1, max(1, int(2 * mean_bytes)), 0
    while low < largest or not nth:
        most = max(1, ARCHIVE_BYTES // (high + HEAD_BYTES))
        some = rows.where((F.col("size") > low) & (F.col("size") <= high))
        some.select("record").write.option("lineSep", "\r\n").option("maxRecordsPerFile", most).text(f"{path}/sizes-{nth}")
        low, high, nth = high, 16 * high if 16 * high < ARCHIVE_BYTES else max(largest, high), nth + 1


def _parse(name: str, content: bytes) -> Iterator[tuple]:
    """Index lines of one archive; a payload is skipped by its length, so it may hold anything."""
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in content[at:head_end].decode().split("\r\n")[1:-2])
        stored = int(head["Content-Length"])
        payload = content[head_end : head_end + stored]
        kind, url = head["WARC-Type"], head["WARC-Target-URI"]
        raw = hashlib.sha1(payload).digest() if kind == "response" else bytes.fromhex(head["WARC-Payload-Digest"][5:])
        if raw.hex() != head["WARC-Payload-Digest"][5:]:
            raise ValueError(f"{name}: the payload at {head_end} differs from its digest")
        end = head_end + stored + 4
        size = stored if kind == "response" else int(head["WARC-Payload-Length"])
        refers = head.get("WARC-Refers-To")
        yield (url_key(url), head["WARC-Date"], head["WARC-Record-ID"][10:-1], url, kind, size, base64.b32encode(raw).decode(), refers and refers[10:-1], name, at, end - at)
        at = end


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query in lower case."""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].lower().rpartition("@")[2].partition(":")[0]
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + rest[cut:].partition("#")[0].lower()


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back: the index lines of each file, sorted by url key and time, numbered within their run."""
    schema = T.StructType([*INDEX.fields, T.StructField("nth", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                lines = sorted(_parse(name.as_py(), content.as_py()), key=lambda x: (x[:3], x[9]))
                columns = [*zip(*lines, strict=True)] or [()] * len(INDEX)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(columns, INDEX, strict=True)), pa.array(range(len(lines)), pa.int64())], names=schema.names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merges sorted runs: inner nodes keep the loser of their match, so each step replays one path."""
    k = len(runs)
    if not k:
        return
    end = (1,)
    heads = [next(r, None) for r in runs]
    keys = [end if h is None else (0, key(h)) for h in heads]
    tree = [-1] * k

    def replay(i: int) -> int:
        node = (i + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = i
                return -1
            if keys[tree[node]] < keys[i] or (keys[tree[node]] == keys[i] and tree[node] < i):
                tree[node], i = i, tree[node]
            node //= 2
        return i

    winner = -1
    for i in range(k):
        found = replay(i)
        winner = found if found >= 0 else winner
    while keys[winner] != end:
        yield heads[winner]
        heads[winner] = head = next(runs[winner], None)
        keys[winner] = end if head is None else (0, key(head))
        winner = replay(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """A globally ordered index: parts hold consecutive ranges of (url_key, captured, page_id), merged from the runs.

    Key ranges go on within one url, so a url with most captures is spread over many parts.
    The part number is the column ``part``.
    """
    lines = written(runs, "runs")
    parts = lines.count() // PART_LINES + 1
    names = lines.columns
    where = {c: i for i, c in enumerate(names)}
    ranged = lines.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "offset").sortWithinPartitions("archive", "nth")
    schema = T.StructType([*lines.schema.fields, T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        rows = zip(*(c.to_pylist() for c in table.columns), strict=True)
        runs = [iter([*g]) for _, g in itertools.groupby(rows, key=lambda r: r[where["archive"]])]
        merged = [*loser_tree(runs, key=lambda r: (r[0], r[1], r[2], r[where["archive"]], r[where["offset"]]))]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*merged, strict=True), table.schema, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([TaskContext.get().partitionId()] * len(merged), pa.int32())], names=schema.names)

    return ranged.mapInArrow(run, schema)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", captured=None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes the archives of ``pages``, reads them back and merges their index: the index, and the archives' folder.

    The index has INDEX's columns, ``nth`` (place in its run) and ``part``. Ids come back as
    strings; an empty string stands for a null id. An empty table gives an empty index.
    """
    path = new_path(pages.sparkSession, "warc")
    size = F.octet_length(F.coalesce(F.col(f"`{payload}`"), F.lit("")))
    mean, largest = pages.agg(F.avg(size), F.max(size)).first()
    write_archives(records(pages, page_id, url, payload, captured, least_bytes), path, mean or 0.0, largest or 0)
    return merge_runs(index_runs(pages.sparkSession, path)), path
