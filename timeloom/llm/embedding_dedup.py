"""Embedding near-dedup: epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, fields, lists, written
from .components import components

#: Leading principal dimensions whose grid cells order the vectors.
DIMENSIONS = 8

#: Vectors in one interval of the order, and in a piece of it that is compared without further cuts.
BLOCK, LEAF = 1024, 96

BINARY, INT, DOUBLE = T.BinaryType(), T.IntegerType(), T.DoubleType()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    size = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, _unit(_matrix(batch.column("vec").take(pa.array(rows))))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The leading axes of the commonest vector size, from products summed over all vectors; other sizes keep theirs."""
    common = vectors.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return {}
    dim = common.dim
    schema = T.StructType(fields(cell=LONG, value=DOUBLE))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim + 1))
        for batch in batches:
            for size, _, unit in _by_dimension(batch):
                if size == dim:
                    total[:, :dim] += unit.T @ unit
                    total[:, dim] += unit.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=schema.names)

    cells = vectors.select("vec").mapInArrow(sums, schema).groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(dim * (dim + 1))
    flat[cells["cell"].to_numpy(np.int64)] = cells["value"].to_numpy(float)
    total = flat.reshape(dim, dim + 1) / common.n
    _, axes = np.linalg.eigh(total[:, :dim] - np.outer(total[:, dim], total[:, dim]))
    return {dim: axes[:, ::-1][:, :DIMENSIONS]}


def _project(unit: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    found = axes.get(unit.shape[1])
    return unit @ found if found is not None else unit[:, :DIMENSIONS]


def _blocks(vectors: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Intervals of the epsilon grid order: vectors of one label and size, sorted by their cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    schema = T.StructType([*vectors.schema.fields, *fields(dim=INT, cells=T.ArrayType(INT))])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, unit in _by_dimension(batch):
                grid = np.floor(_project(unit, shared.value) / eps).astype(np.int32)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([dim] * len(rows), pa.int32()), lists(pa.array(grid.ravel()), np.full(len(rows), grid.shape[1]))], names=schema.names)

    placed = written(vectors.mapInArrow(cells, schema), "cells")
    parts = int(placed.count() // (4 * BLOCK)) + 1
    order = ["label", "dim", "cells", "id"]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    box = T.ArrayType(DOUBLE)
    out = T.StructType([vectors.schema["label"], *fields(dim=INT, part=INT, nth=INT), T.StructField("ids", T.ArrayType(vectors.schema["id"].dataType)), *fields(low=box, high=box, vecs=BINARY)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held = TaskContext.get().partitionId(), 0, None

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal nth
            nth += 1
            rows = rows.combine_chunks()
            unit = _unit(_matrix(rows.column("vec").combine_chunks()))
            place = _project(unit, shared.value)
            values = [rows.column("label")[0].as_py(), rows.column("dim")[0].as_py(), part, nth, rows.column("id").to_pylist(), place.min(axis=0).tolist(), place.max(axis=0).tolist(), unit.astype("<f8").tobytes()]
            id_type, label_type = rows.schema.field("id").type, rows.schema.field("label").type
            kinds = [label_type, pa.int32(), pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=out.names)

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            label, dim = (np.array(held.column(c).to_pylist(), object) for c in ("label", "dim"))
            edges = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            at = 0
            for end in [*edges, len(label)]:
                while end - at >= BLOCK or (end < len(label) and end > at):
                    step = min(BLOCK, end - at)
                    yield block(held.slice(at, step))
                    at += step
            held = held.slice(at) if at < len(label) else None
        if held is not None and held.num_rows:
            yield block(held)

    return written(ranged.mapInArrow(cut, out), "blocks")


def _leaves(a: np.ndarray, b: np.ndarray, eps: float, i: int, j: int, m: int, n: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of short pieces a[i:m], b[j:n] that are not provably farther apart than eps, by halving the longer one."""
    gap = np.maximum(np.maximum(b[j:n].min(axis=0) - a[i:m].max(axis=0), a[i:m].min(axis=0) - b[j:n].max(axis=0)), 0)
    if (gap * gap).sum() > eps * eps:
        return
    if m - i <= LEAF and n - j <= LEAF:
        yield i, j, m, n
    elif same and i == j and m == n:
        half = (i + m) // 2
        yield from _leaves(a, b, eps, i, i, half, half, same)
        yield from _leaves(a, b, eps, i, half, half, m, same)
        yield from _leaves(a, b, eps, half, half, m, m, same)
    elif m - i >= n - j:
        half = (i + m) // 2
        yield from _leaves(a, b, eps, i, j, half, n, same)
        yield from _leaves(a, b, eps, half, j, m, n, same)
    else:
        half = (j + n) // 2
        yield from _leaves(a, b, eps, i, j, m, half, same)
        yield from _leaves(a, b, eps, i, half, m, n, same)


def _roots(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches, by label passing and pointer jumping."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, rows, root[columns])
        np.minimum.at(new, columns, root[rows])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(x: np.ndarray, y: np.ndarray, axes: dict[int, np.ndarray], least: float, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of x and then of y across the two blocks, and the root of each in their link graph."""
    a, b = _project(x, axes), _project(y, axes)
    links = np.zeros(len(x) + len(y), np.int64)
    root = np.arange(len(x) + len(y))
    offset = 0 if same else len(x)
    for i, j, m, n in _leaves(a, b, eps, 0, 0, len(a), len(b), same):
        near = x[i:m] @ y[j:n].T >= least
        inner = same and i == j
        if inner:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        links[i:m] += near.sum(axis=1)
        if not inner:
            links[offset + j : offset + n] += near.sum(axis=0)
        r, c = np.nonzero(near)
        ends = np.unique(np.stack([root[r + i], root[offset + c + j]], 1), axis=0)
        root = _roots(ends[:, 0], ends[:, 1], len(root))[root]
    return links, root


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept.

    Vectors of equal, non-null label and equal size link when their cosine, in double
    precision, is ``least`` or more. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing. Every row is a vector of its own, so equal rows
    link; component_id is the smallest key that links reach (a null key is larger than all),
    and a row is kept if that is its own. Links are counted where they are found and never
    listed: each pair of intervals gives its vectors' counts and a spanning forest.
    """
    item = F.col("vec")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vec"), F.col(f"`{label}`").alias("label"))
    sound = ~F.exists(item, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(item, lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    eps = float(np.sqrt(2 - 2 * least)) + 1e-7
    usable = rows.where(valid)
    axes = principal_axes(usable)
    blocks = _blocks(usable, axes, eps)
    number = F.shiftleft(F.shiftleft(F.col("part").cast("long"), 20).bitwiseOR(F.col("nth").cast("long")), 12)
    blocks = blocks.withColumn("block", number)

    first = lambda c, by: F.floor(F.get(c, F.lit(0)) / eps + by).cast("int")
    one = blocks.select("label", "dim", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(first("low", 0), first("high", 0))).alias("cell"))
    two = blocks.select("label", "dim", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(first("low", -1), first("high", 1))).alias("cell"))
    gaps = F.zip_with(F.zip_with("low_b", "high_a", lambda p, q: p - q), F.zip_with("low_a", "high_b", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g * g) <= eps * eps
    met = written(one.join(two, ["label", "dim", "cell"]).where((F.col("a") <= F.col("b")) & near).select("dim", "a", "b").distinct(), "block-pairs")
    side = lambda name: blocks.select(F.col("block").alias(name), F.col("vecs").alias(f"vecs_{name}"))
    schema = T.StructType(fields(node=LONG, links=LONG, root=LONG))
    shared = vectors.sparkSession.sparkContext.broadcast(axes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, a, b, p, q in zip(*(batch.column(c) for c in ("dim", "a", "b", "vecs_a", "vecs_b")), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<f8").reshape(-1, dim.as_py()) for v in (p, q))
                same = a.as_py() == b.as_py()
                links, root = _block_links(x, y, shared.value, least, eps, same)
                name = np.concatenate([a.as_py() + np.arange(len(x)), b.as_py() + np.arange(len(y))])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(links[some]), pa.array(name[root[some]])], names=schema.names)

    found = written(met.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, schema), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = blocks.select("block", F.posexplode("ids").alias("at", "id")).select((F.col("block") + F.col("at")).alias("node"), "id")
    members = members.join(counts, "node", "left").join(grouped, "node", "left")
    least_id = members.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("least"))
    linked = members.join(least_id, "component", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    alone = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
