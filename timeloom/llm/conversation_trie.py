"""Conversation prefix trie: bitsets of conversations for each (place, turn), intersected depth first within tiles of a shard, nodes merged over shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, TEXT, discard, fields, written

#: Conversations of a shard and places of a tile: what one task holds is at most their product.
SHARD, TILE = 1024, 64

#: Depths of one conversation that are summed up at a time.
STRETCH = 4096

BINARY = T.BinaryType()

#: Digest of a node at which no conversation ends.
NONE = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, hi, lo, words) of each turn: its place in its conversation from 0, two hashes of role and text, and its number of words.

    A conversation's turns are in ascending ``order``, null first; of equal numbers, by the hashes. Null role or text is empty; rows
    without a conversation are left out, further columns ignored. Turns are sorted over all tasks, so that a conversation may be longer than a task's share: rows that
    repeat are dealt out too, and places go on where the task before left off.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    some = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{order}`").alias("turn"), F.xxhash64(role, text).alias("hi"), F.xxhash64(F.lit(1), text, role).alias("lo"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")
    )
    some = written(some.withColumn("tie", F.monotonically_increasing_id()), "turns")
    schema = T.StructType(fields(task=LONG, conv=LONG, nth=LONG, hi=LONG, lo=LONG, words=LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, behind = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv").to_numpy()
            at = np.arange(len(ids))
            start = np.maximum.accumulate(np.where(np.append(True, ids[1:] != ids[:-1]), at, 0))
            nth = at - start
            if last == ids[0]:
                nth[ids == last] += behind
            last, behind = ids[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), TaskContext.get().partitionId())), batch.column("conv"), pa.array(nth), *(batch.column(c) for c in ("hi", "lo", "words"))], names=schema.names)

    order_by = ["conv", "turn", "hi", "lo", "tie"]
    dealt = written(some.repartitionByRange(*order_by).sortWithinPartitions(*order_by).mapInArrow(run, schema), "dealt")
    discard(some)
    parts = dealt.groupBy("task", "conv").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("task")) - F.col("n")).where("before > 0").drop("n")
    # only a task's first conversation began before it: as many rows as tasks
    placed = dealt.join(F.broadcast(before), ["task", "conv"], "left").select("conv", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("place"), "hi", "lo", "words")
    found = written(placed, "places")
    discard(dealt)
    return found


def sharded(convs: DataFrame, size: int = SHARD) -> DataFrame:
    """Distinct conversations (conv, length) with a shard of ``size`` of them at most; shards are ranges of ids."""
    schema = T.StructType(fields(conv=LONG, length=LONG, shard=LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            shard = (TaskContext.get().partitionId() << 32) + (seen + np.arange(batch.num_rows)) // size
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("length"), pa.array(shard, pa.int64())], names=schema.names)

    return convs.select("conv", "length").repartitionByRange("conv").sortWithinPartitions("conv").mapInArrow(run, schema)


def _tile_items(items: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """(shard, tile, conv, place, hi, lo, words, last): hashes of turns with their places, and for tiles behind the first the key that each conversation enters with, at place -1.

    A node's key is the exclusive or of the hashes of its turns at their places, two times 64 bits; so a conversation's key at any depth comes from sums of its tiles.
    """
    placed = items.join(convs, "conv").select("shard", F.floor(F.col("place") / size).alias("tile"), "conv", "place", F.xxhash64("place", "hi", "lo").alias("hi"), F.xxhash64(F.lit(2), "lo", "place", "hi").alias("lo"), "words", (F.col("place") + 1 == F.col("length")).alias("last"), "length")
    sums = placed.where(F.col("length") > size).groupBy("shard", "conv", "tile").agg(F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"), F.max("length").alias("length"))
    upto = Window.partitionBy("conv").orderBy("tile")
    entries = sums.select("shard", (F.col("tile") + 1).alias("tile"), "conv", F.lit(-1).cast("long").alias("place"), F.bit_xor("hi").over(upto).alias("hi"), F.bit_xor("lo").over(upto).alias("lo"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("last"), "length")
    return placed.unionByName(entries.where(F.col("tile") * size < F.col("length"))).drop("length")


_NODE = fields(shard=LONG, tile=LONG, hi=LONG, lo=LONG, up_hi=LONG, up_lo=LONG, depth=LONG, n=LONG, conv=LONG, words=LONG, members=BINARY, ends=TEXT, first_end=LONG)


def _slots(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def tile_nodes(table: pa.Table, size: int = TILE) -> pa.Table:
    """The nodes of one tile: postings (place, turn) -> bitset of conversations, intersected with the parent's bitset depth first.

    Of a parent's conversations the first is looked up at the next place; its posting cut with the parent is a child, and
    so on with those left. A child's population count, its first conversation and the bitset of those that end there are
    the node's.
    """
    shard, tile = table["shard"][0].as_py(), table["tile"][0].as_py()
    conv, place, hi, lo, words, last = (table[c].to_numpy() for c in ("conv", "place", "hi", "lo", "words", "last"))
    ids, slot = np.unique(conv, return_inverse=True)
    entry = np.flatnonzero(place < 0)
    keys = {int(slot[i]): (int(hi[i]), int(lo[i])) for i in entry}
    turns = np.flatnonzero(place >= 0)
    turns = turns[np.lexsort((slot[turns], lo[turns], hi[turns], place[turns]))]
    place, hi, lo, words, last, slot = (x[turns] for x in (place, hi, lo, words, last, slot))
    fresh = np.append(True, (place[1:] != place[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
    posting = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    bits, ends = [0] * len(heads), [0] * size
    for p, s in zip(posting.tolist(), slot.tolist(), strict=True):
        bits[p] |= 1 << s
    for p, s in zip((place[last] % size).tolist(), slot[last].tolist(), strict=True):
        ends[p] |= 1 << s
    at = np.full((len(ids), size + 1), -1)
    at[slot, place % size] = posting
    at = at.tolist()
    present = [0] * (size + 1)
    for p, head in zip(posting[heads].tolist(), heads.tolist(), strict=True):
        present[int(place[head] % size)] |= bits[p]
    post = [(int(hi[h]), int(lo[h]), int(words[h])) for h in heads]
    parents: dict[tuple[int, int], int] = {}
    for s in range(len(ids)):
        key = keys.get(s, (0, 0))
        parents[key] = parents.get(key, 0) | 1 << s
    rows: list[tuple] = []
    stack = [(0, key, members) for key, members in parents.items()]
    first, names = tile * size, ids.tolist()
    while stack:
        p, key, members = stack.pop()
        left = members & present[p]
        while left:
            s = (left & -left).bit_length() - 1
            number = at[s][p]
            child = left & bits[number]
            left ^= child
            x, y, count = post[number]
            own, n = (key[0] ^ x, key[1] ^ y), child.bit_count()
            over = child & ends[p]
            done = [names[i] for i in _slots(over)]
            packed = child.to_bytes(-(-child.bit_length() // 8), "little") if n > 1 else None
            rows.append((*own, *key, first + p + 1, n, names[s], count, packed, ",".join(map(str, done)) if done else None, done[0] if done else None))
            if over != child and p + 1 < size:
                stack.append((p + 1, own, child))
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(_NODE) - 2)
    kinds = [pa.int64()] * 8 + [pa.binary(), pa.string(), pa.int64()]
    many = len(rows)
    return pa.table([pa.array([shard] * many, pa.int64()), pa.array([tile] * many, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.name for f in _NODE])


def member_sums(nodes: pa.Table, values: pa.Table) -> pa.Table:
    """Of nodes of one tile: what their members' values (total, leaf) add up to."""
    by = np.argsort(values["conv"].to_numpy())
    ids, worth = values["conv"].to_numpy()[by], np.stack([values[c].to_numpy()[by] for c in ("total", "leaf")], axis=1)
    found = np.zeros((nodes.num_rows, 2), np.int64)
    for i, (packed, conv) in enumerate(zip(nodes["members"].to_pylist(), nodes["conv"].to_pylist(), strict=True)):
        if packed is None:
            found[i] = worth[np.searchsorted(ids, conv)]
        else:
            mine = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
            found[i] = mine[: len(ids)].astype(np.int64) @ worth[: len(mine)]
    return pa.table([nodes["hi"], nodes["lo"], pa.array(found[:, 0]), pa.array(found[:, 1])], names=["hi", "lo", "total", "leaf"])


def _end_digests(pieces: DataFrame) -> DataFrame:
    """(hi, lo, digest) of comma-joined ids in ascending order; the pieces of a node come one after the other and are hashed as they come."""
    schema = T.StructType(fields(hi=LONG, lo=LONG, digest=TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for hi, lo, piece in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ends")), strict=True):
                if (hi, lo) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (hi, lo), hashlib.sha256()
                state.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=schema.names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=schema.names)

    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first_end").select("hi", "lo", "ends").mapInArrow(run, schema)


def _rest_of_chain(nodes: DataFrame) -> DataFrame:
    """Of shared nodes (hi, lo, conv, depth, worth): the worth of the nodes with the same first conversation from their depth on, and of all of them."""
    part = nodes.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    sums = part.groupBy("conv", "stretch").agg(F.sum("worth").alias("its"))
    deeper = Window.partitionBy("conv").orderBy(F.desc("stretch"))
    sums = sums.select("conv", "stretch", (F.sum("its").over(deeper) - F.col("its")).alias("behind"), F.sum("its").over(Window.partitionBy("conv")).alias("whole"))
    own = F.sum("worth").over(Window.partitionBy("conv", "stretch").orderBy(F.desc("depth")))
    return part.withColumn("own", own).join(sums, ["conv", "stretch"]).select("hi", "lo", (F.col("own") + F.col("behind")).alias("rest"), "whole")


def trie(items: DataFrame, convs: DataFrame, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """One row per node of the trie of the conversations' turns, the textless root too: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``items`` are turns (conv, place from 0 without gaps, hi, lo, words), ``convs`` all conversations (conv, length), those without a turn
    too. A node is known by 128 bits of hashes. conv_id is its smallest member, saved_tokens what its subtree's nodes save if each last turn is
    kept once, ends_sha256 the digest of the ids of the conversations that end there. Without conversations there is no node.

    A node's first conversation stays that of one path downward, so what a subtree saves is what is left of the node's own path, and
    whole paths of its other members; their sums and the leaves, one at the end of a path at most, come from the bitsets again.
    """
    convs = written(sharded(convs, shard), "convs")
    grouped = _tile_items(items, convs, tile).groupBy("shard", "tile").applyInArrow(lambda table: tile_nodes(table, tile), T.StructType(_NODE))
    tiles = written(grouped, "tiles")
    key = ["hi", "lo"]
    merged = tiles.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("up_hi", "up_lo", "depth", "words")], F.sum("n").alias("n"), F.min("conv").alias("conv"))
    merged = written(merged, "nodes")
    kids = merged.groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count(F.lit(1)).alias("children"))
    nodes = merged.join(kids, key, "left").select(*merged.columns, F.coalesce("children", F.lit(0)).alias("children"), (F.col("words") * (F.col("n") - 1)).alias("worth"))
    nodes = written(nodes, "nodes")
    discard(merged)
    shared = written(nodes.where("n > 1"), "shared")

    # one row per conversation that is some node's first: the sum of its path, whether a leaf ends it, and where it begins
    top = F.min(F.struct("depth", "up_hi", "up_lo", *key)).alias("top")
    paths = written(nodes.groupBy("conv").agg(F.sum("worth").alias("total"), F.max((F.col("children") == 0).cast("long")).alias("leaf"), top), "paths")
    values = convs.where("length > 0").join(paths.select("conv", "total", "leaf"), "conv", "left").select("shard", "conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / tile))).alias("tile"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = tiles.join(shared.select(*key), key, "left_semi").select("shard", "tile", *key, "conv", "members")
    sums = members.groupBy("shard", "tile").cogroup(values.groupBy("shard", "tile")).applyInArrow(lambda a, b: member_sums(a, b), T.StructType(fields(hi=LONG, lo=LONG, total=LONG, leaf=LONG)))
    sums = sums.groupBy(*key).agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf"))

    whole = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    of_all = paths.agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaf")).first()
    tops = paths.select("conv", "top.*")
    under_root = tops.where("depth = 1").select(*key, F.lit(whole.conv).cast("long").alias("parent"))
    parents = shared.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv").alias("parent"))
    parents = tops.where("depth > 1").join(parents, ["up_hi", "up_lo"]).select(*key, "parent").unionByName(under_root)

    pieces = tiles.where("ends IS NOT NULL").select(*key, "first_end", "ends")
    turnless = convs.where("length = 0").groupBy("shard").agg(F.min("conv").alias("first_end"), F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ends"))
    nowhere = F.lit(0).cast("long")
    digests = _end_digests(pieces.unionByName(turnless.select(nowhere.alias("hi"), nowhere.alias("lo"), "first_end", "ends")))

    root = convs.sparkSession.range(int(whole.n > 0)).select(
        nowhere.alias("hi"), nowhere.alias("lo"), nowhere.alias("depth"), F.lit(whole.n).cast("long").alias("n"), F.lit(whole.conv).cast("long").alias("conv"), F.lit(of_all.total or 0).cast("long").alias("rest"), nowhere.alias("whole"), nowhere.alias("total"), F.lit(max(1, of_all.leaf or 0)).cast("long").alias("leaf")
    )
    children = F.lit(nodes.where("depth = 1").count()).cast("long")
    parts = [nodes.select(*key, "depth", "n", "conv", "children"), root.withColumn("children", children), _rest_of_chain(shared), sums, parents, digests]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.groupBy(*key).agg(*[F.max(c).alias(c) for c in rows.columns if c not in key])
    alone = F.col("n") == 1
    under = lambda c: F.when(F.col("depth") > 0, c)
    # a conversation alone shares nothing below; a path's own nodes hang on each other
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        under(F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("leaf")).alias("n_leaves"),
        F.when(alone, nowhere).otherwise(F.col("rest") + F.col("total") - F.col("whole")).alias("saved_tokens"),
        F.coalesce("digest", F.lit(NONE)).alias("ends_sha256"),
    )


def headed(items: DataFrame, every: int, share: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations (items, convs) that begin as others do: the first ``share`` (of column conv) turns are those of the conversation of the next lower multiple of ``every``, all if it has fewer, none if there is none; the conversation's own from that place on follow."""
    convs = written(items.groupBy("conv").agg(F.count(F.lit(1)).alias("size")).select("conv", "size", share.cast("long").alias("h"), (F.col("conv") - F.col("conv") % every).alias("leader")), "convs")
    sizes = convs.where("conv = leader").select("leader", F.col("size").alias("leader_size"))
    told = convs.join(sizes, "leader", "left").select("conv", "leader", "size", "h", F.least("h", F.coalesce("leader_size", F.lit(0))).alias("taken"))
    told = written(told.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "told")
    discard(convs)
    most = told.agg(F.max("h")).first()[0] or 0
    heads = items.where((F.col("conv") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv", "leader")
    columns = ["conv", "place", "hi", "lo", "words"]
    begun = heads.join(told, "leader").where(F.col("place") < F.col("h")).select(*columns)
    own = items.join(told.select("conv", "h", "taken"), "conv").where(F.col("place") >= F.col("h")).withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    return begun.unionByName(own.select(*columns)), told.select("conv", "length")
