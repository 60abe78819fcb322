"""N-gram Jaccard join: token-combination prefixes over word shingles, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import LONG, chunks, discard, fields, lists, own_name, written
from .components import LARGE, Side, buckets, components, leader_pairs, open_pairs, pair, sides

U = np.uint64

#: Shingles fall into 2^CLASS_BITS token classes by their hash; corpus counts are kept by class.
CLASS_BITS = 18

#: A class is frequent if its shingles stand in this share of the documents or more.
FREQUENT = 0.02

#: Frequent shingles are split into so many groups; pairs are built within a group.
GROUPS = 8

#: Prefix shingles that two linked sets share at least.
SURE = GROUPS + 1

#: Rows of (node, key) that are broadcast at most.
BROADCAST_ROWS = 1_000_000

#: 64-bit numbers of a node's bitmap: each bit tells whether an odd number of its shingles fall on it.
BITMAP = 8

CHUNK = 2_000_000
INT = T.IntegerType()
_BITS = [f"b{i}" for i in range(BITMAP)]


def shingle_sets(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within it, and their numbers."""
    h = W.hashes(found.data, found.start, found.end)
    counts = found.counts
    row = np.repeat(np.arange(len(counts)), counts)
    begins = np.flatnonzero(np.arange(len(h)) + size <= found.first[1:][row]) if len(h) else np.zeros(0, np.int64)
    whole = W.grams(h, size)[begins] if len(begins) else np.zeros(0, U)
    owner = row[begins]
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            value = np.full(len(few), n, U)
            for i in range(n):
                value = W.mix(value * U(0xD6E8FEB86659FD93) + h[found.first[few] + i])
            whole, owner = np.append(whole, value), np.append(owner, few)
    if len(whole) > len(begins):
        by = np.argsort(owner, kind="stable")
        whole, owner = whole[by], owner[by]
    return _sorted_rows(whole, np.bincount(owner, minlength=len(counts)))


def _sorted_rows(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    values = values.copy()
    for a, b in zip(ends - sizes, ends, strict=True):
        values[a:b].sort()
    row = np.repeat(np.arange(len(sizes)), sizes)
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[fresh], np.bincount(row[fresh], minlength=len(sizes))


def fingerprints(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash of each row's set."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(W.mix(values + U(0x632BE59BD9B4E019)), dtype=U)])
    ends = np.cumsum(sizes)
    return W.mix(total[ends] - total[ends - sizes] + sizes.astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def bitmaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each row BITMAP numbers of 64 bits. Two rows' bits differ in no more places than their sets."""
    width = 64 * BITMAP
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(row * width + (values % U(width)).astype(np.int64), minlength=len(sizes) * width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), BITMAP)


def survey(docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Per row (key, n, print, its bitmap), and counts of shingles by token class over all rows."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *fields(n=LONG, print=LONG, cls=INT, freq=LONG), *fields(**dict.fromkeys(_BITS, LONG))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << CLASS_BITS, np.int64), None
        for batch, data, offsets in chunks(batches, text, CHUNK):
            values, sizes = shingle_sets(W.find(data, offsets, W.SPACED), size)
            counts += np.bincount((values >> U(64 - CLASS_BITS)).astype(np.int64), minlength=len(counts))
            kind, empty = batch.column(key).type, [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int64()), pa.array(fingerprints(values, sizes)), pa.array(empty, pa.int32()), pa.array(empty, pa.int64()), *map(pa.array, bitmaps(values, sizes).T)], names=schema.names)
        some = np.flatnonzero(counts)
        if len(some):
            empty = [None] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(empty, kind), pa.array(empty, pa.int64()), pa.array(empty, pa.int64()), pa.array(some, pa.int32()), pa.array(counts[some]), *[pa.array(empty, pa.int64())] * BITMAP], names=schema.names)

    both = written(docs.select(F.col(key), F.col(text)).mapInArrow(run, schema), "survey")
    rows = both.where(F.col("n").isNotNull()).select(key, "n", "print", *_BITS)
    return rows, both.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.sum("freq").alias("freq"))


def class_levels(classes: DataFrame, documents: int) -> np.ndarray:
    """A level for each token class, from 0 (rare): the logarithm of its count against the mean; 64 is added if it is frequent.

    There are 2^CLASS_BITS classes whatever the corpus, so this has a fixed size.
    """
    counts = np.zeros(1 << CLASS_BITS, np.float64)
    table = classes.toPandas()
    counts[table["cls"].to_numpy(np.int64)] = table["freq"].to_numpy(np.float64)
    mean = max(1.0, counts.sum() / len(counts))
    level = np.floor(2 * np.log2(np.maximum(counts / mean, 1))).astype(np.uint8)
    return np.minimum(level, 63) + 64 * ((counts >= FREQUENT * documents) & (counts >= 4 * mean)).astype(np.uint8)


def signatures(values: np.ndarray, sizes: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Signatures of each row's prefix: (row, signature, place in the prefix or -1, frequent shingles in the prefix).

    Two sets that link share SURE = GROUPS + 1 shingles of their prefixes, so either a rare
    one or two of one frequent group: rare shingles are indexed one by one, frequent ones in
    pairs within their group. Sets so small that fewer shared shingles are sure have all of
    them indexed both ways. Shingles are taken from rare to frequent classes.
    """
    level = levels[(values >> U(64 - CLASS_BITS)).astype(np.int64)]
    key = (level.astype(U) << U(57)) | (values >> U(7))
    ends = np.cumsum(sizes)
    out: list[tuple[np.ndarray, ...]] = []
    for row, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        n = int(b - a)
        if not n:
            continue
        alpha = -(-percent * n // 100)
        small = alpha < SURE
        length = n if small else n - alpha + SURE
        order = np.sort(key[a:b])[:length]
        rare = int(np.searchsorted(order, U(64) << U(57)))
        one, rest = order if small else order[:rare], order[rare:]
        out.append((np.full(len(one), row), one, np.arange(len(one)), np.full(len(one), len(rest))))
        for group in range(GROUPS) if len(rest) > 1 else ():
            mine = rest[(rest % U(GROUPS)) == U(group)]
            i, j = np.triu_indices(len(mine), 1)
            out.append((np.full(len(i), row), W.mix(mine[i] * U(0xD6E8FEB86659FD93) + mine[j]), np.full(len(i), -1), np.full(len(i), len(rest))))
    if not out:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U), none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signature_rows(docs: DataFrame, key: str, text: str, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    schema = T.StructType(fields(sig=LONG, node=LONG, n=INT, f=INT, at=INT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, text, CHUNK):
            values, sizes = shingle_sets(W.find(data, offsets, W.SPACED), size)
            row, sig, at, frequent = signatures(values, sizes, shared.value, percent)
            node = fingerprints(values, sizes)
            columns = [sig.view(np.int64), node[row], sizes[row].astype(np.int32), frequent.astype(np.int32), at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    return docs.where(F.col(key).isNotNull()).select(F.col(text)).mapInArrow(run, schema)


def _set_rows(docs: DataFrame, text: str, size: int) -> DataFrame:
    schema = T.StructType(fields(node=LONG, items=T.ArrayType(LONG)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, text, CHUNK):
            values, sizes = shingle_sets(W.find(data, offsets, W.SPACED), size)
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(values, sizes)), lists(pa.array(values.view(np.int64)), sizes)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcasts a written table if it has few rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(docs: DataFrame, key: str, text: str, size: int, percent: int, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of set prints that link: their sets are built again from one document each and intersected."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = _bounded(written(ends.join(reps, "node").select("node", F.col("rep").alias("_rep")), "wanted"))
    texts = docs.join(wanted.select("_rep").distinct(), F.col("_key") == F.col("_rep"), "left_semi")
    sets = written(_set_rows(texts.select("_text"), "_text", size).join(wanted.select("node"), "node", "left_semi"), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("items").alias(f"items_{name}"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    linked = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * (F.size("items_a") + F.size("items_b") - both))
    found = written(linked.select("a", "b").distinct(), "links")
    discard(pairs, sets)
    return found


def _able(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Without nodes that share too few shingles with any others to have a link; rows of large buckets get their node's bitmap."""
    alpha = F.ceil(percent * F.col("n") / 100 - 1e-9)
    rows = shared.withColumn("met", F.count_if(F.col("at") >= 0).over(Window.partitionBy("node")))
    able = rows.where(F.col("met") + F.col("f") >= F.least(F.lit(SURE), alpha)).join(nodes.select("node", *_BITS), "node", "left")
    bits = [F.when(F.col("many") >= LARGE, F.col(b)).alias(b) for b in _BITS]
    able = written(able.select("sig", "node", "n", "f", "at", *bits), "able")
    discard(shared)
    return able


def _most_frequent(pairs: str) -> Column:
    """The most frequent shingles that two prefixes can share if they share so many pairs: c in each group make c (c - 1) / 2."""
    each = F.floor((1 + F.sqrt(1 + 8 * F.col(pairs) / GROUPS)) / 2 + 1e-9)
    return GROUPS * each + F.floor((F.col(pairs) - GROUPS * each * (each - 1) / 2) / each)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles and component_id.

    A document's set has its distinct ``size``-word shingles, or all its words as one if it
    has fewer. Two documents link when 100 * intersection >= percent * union; component_id
    is the smallest key that links lead to. Null and empty texts have no shingles and link
    with nothing, and a row whose key is null has its own null component. Equal sets are one
    node of the graph, so copies are never paired. Rows of one key are separate documents.

    Nodes of a signature's bucket are first tried against a leader if the bucket is large;
    then only nodes that are not yet connected are paired. There, two sets whose bitmaps differ in
    more bits than linked sets can differ in shingles are no pair. A pair is verified if its prefixes
    share as many shingles as its overlap asks for: the i-th shared shingle of o has o - i
    behind it, so it lies in a prefix of p of n shingles if i <= o - n + p.
    """
    name = key
    docs = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    key, text = "_key", "_text"
    survey_rows, classes = survey(docs, key, text, size)
    documents = survey_rows.count()
    levels = class_levels(classes, documents)
    nodes = survey_rows.where((F.col("n") > 0) & F.col(key).isNotNull()).groupBy(F.col("print").alias("node")).agg(F.min(F.col(key)).alias("rep"), *[F.first(b).alias(b) for b in _BITS])
    nodes = written(nodes, "nodes")
    shared = _able(buckets(_signature_rows(docs, key, text, size, percent, levels), counted=True), nodes, percent)
    left, right = sides()
    need = F.ceil(percent * (left("n") + right("n")) / (100 + percent) - 1e-9)
    sizes = 100 * F.least(left("n"), right("n")) >= percent * F.greatest(left("n"), right("n"))
    placed = (left("at") < 0) | (right("at") < 0) | (F.least(left("n") - left("at"), right("n") - right("at")) >= need)
    # what two sets can share before, at and behind a shingle that stands in both
    room = F.least(left("at"), right("at")) + F.least(left("n") - left("at"), right("n") - right("at"))
    sizes &= (left("at") < 0) | (right("at") < 0) | (room >= need)
    # sets differ in as many shingles as their bitmaps in bits at least
    differ = sum((F.bit_count(left(b).bitwiseXOR(right(b))) for b in _BITS), F.lit(0))
    sizes &= F.coalesce(differ <= left("n") + right("n") - 2 * need, F.lit(True))
    verified = lambda pairs: _verified(docs, key, text, size, percent, nodes, pairs)
    links = verified(leader_pairs(shared, sizes & placed))
    met = open_pairs(shared, links, sizes)

    def prefix(side: Side) -> Column:
        alpha = F.ceil(percent * side("n") / 100 - 1e-9)
        return F.when(alpha < SURE, side("n")).otherwise(side("n") - alpha + SURE)

    sure = need + F.least(prefix(left) - left("n"), prefix(right) - right("n"))
    met = met.select(*pair(), sure.alias("sure"), placed.alias("placed"), (left("at") >= 0).alias("single"), F.least(left("f"), right("f")).alias("f"))
    met = met.groupBy("a", "b").agg(F.count_if("single").alias("singles"), F.count_if(~F.col("single")).alias("pairs"), F.max("sure").alias("sure"), F.max("placed").alias("placed"), F.max("f").alias("f"))
    more = verified(met.where(F.col("placed") & (F.col("singles") + F.least(F.col("f"), _most_frequent("pairs")) >= F.col("sure"))).select("a", "b"))
    grouped = components(links.unionByName(more))
    least = nodes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = least.join(least.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(F.col("node").alias("print"), "component_id")
    least = written(least, "least")
    known = F.when((F.col("n") > 0) & F.col(key).isNotNull(), F.col("component_id")).otherwise(F.col(key))
    return survey_rows.join(least, "print", "left").select(F.col(key).alias(name), F.col("n").alias("n_shingles"), known.alias("component_id"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group that links of ``join`` connect: that with the smallest key, of equal keys the
    smallest hash of its text, of equal rows any.

    A null key is the smallest; unlike texts of one key are judged one by one. Rows without a shingle all stay.
    """
    mine = own_name(docs, "_row")
    named = docs.withColumn(mine, F.struct(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")).alias("print")))
    rows = written(join(named, mine, text, size, percent).where("n_shingles > 0"), "rows")
    gone = written(rows.where(F.col(mine) != F.col("component_id")).select(mine).distinct(), "gone")
    again = written(rows.groupBy(mine).agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(mine), "again")
    discard(rows)
    kept = named.join(gone, mine, "left_anti")
    once, several = kept.join(again, mine, "left_anti"), kept.join(again, mine, "left_semi").dropDuplicates([mine])
    return once.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])
