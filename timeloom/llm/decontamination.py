"""Benchmark decontamination: an FM-index per shard of the training texts, searched for test phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import LONG, TEXT, chunks, fields, lists, own_name
from .fm_index import FMIndex

#: Bytes of text in one shard; its index takes some thirty times that.
SHARD_BYTES = 3_000_000

#: Bytes of test phrases that are searched for in one pass over the texts.
PASS_BYTES = 32_000_000


class Phrases:
    """The windows of test items as rows of word ids, by their length."""

    def __init__(self, items: list[tuple[str | None, str]], k: int):
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: i for i, name in enumerate(self.names)}
        texts = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        found = W.find(np.frombuffer(b"".join(texts), np.uint8), offsets, W.ALNUM)
        self.vocabulary, ids = np.unique(W.hashes(found.data, found.start, found.end), return_inverse=True)
        windows: dict[int, dict[tuple, set]] = {}
        for (name, _), a, b in zip(items, found.first[:-1], found.first[1:], strict=True):
            length = min(k, b - a)
            for at in range(a, b - length + 1) if length else ():
                windows.setdefault(int(length), {}).setdefault(tuple(ids[at : at + length] + 1), set()).update([number[name]] if name is not None else [])
        self.groups = []
        for length, by in sorted(windows.items()):
            owners = [sorted(v) for v in by.values()]
            self.groups.append((length, np.array(list(by), np.int64), np.concatenate([np.array(v, np.int64) for v in owners]), np.concatenate([[0], np.cumsum([len(v) for v in owners])])))
        self.shortest = min(windows, default=0)

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        """Word ids from 1; 0 for words of no phrase."""
        if not len(self.vocabulary):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at + 1, 0)


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … sizes[0] of them, then the next."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(sizes) else np.zeros(0, np.int64)


def search_shard(found: W.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit, and (row, item) pairs, of the rows that ``found`` holds.

    Words that no phrase has end a run, and runs too short for any phrase stay out of the
    index: neither can hold an occurrence.
    """
    hit = np.zeros(len(found.start), bool)
    none = np.zeros(0, np.int64)
    if not phrases.groups or not len(found.start):
        return hit, none, none
    symbol = phrases.symbols(W.hashes(found.data, found.start, found.end))
    inside = symbol > 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    heads = found.first[:-1][found.counts > 0]
    fresh[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:]
    begin, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    long = end - begin >= phrases.shortest
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return hit, none, none
    at = _expand(begin, size)
    slot = np.arange(len(at)) + np.repeat(np.arange(len(size)), size)
    total = len(at) + len(size)
    text, origin = np.zeros(total, np.int64), np.zeros(total, np.int64)
    text[slot], origin[slot] = symbol[at], at
    index = FMIndex(text)
    edges = np.zeros(len(hit) + 1, np.int64)
    row_of = found.row
    rows, items = [], []
    for length, patterns, owners, owner_at in phrases.groups:
        lo, hi = index.find(patterns)
        which = np.repeat(np.arange(len(patterns)), hi - lo)
        where = origin[index.locate(_expand(lo, hi - lo))]
        np.add.at(edges, where, 1)
        np.add.at(edges, where + length, -1)
        pairs = np.unique(row_of[where] * len(patterns) + which)
        row, which = pairs // len(patterns), pairs % len(patterns)
        many = owner_at[which + 1] - owner_at[which]
        rows.append(np.repeat(row, many))
        items.append(owners[_expand(owner_at[which], many)])
    hit = np.cumsum(edges[:-1]) > 0
    pairs = np.unique(np.concatenate(rows) * max(1, len(phrases.names)) + np.concatenate(items))
    return hit, pairs // max(1, len(phrases.names)), pairs % max(1, len(phrases.names))


def _spans(found: W.Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans as first word and the word behind the last, and the number that each row has."""
    heads = np.zeros(len(hit) + 1, bool)
    heads[found.first[:-1]] = True
    fresh = hit & (heads[:-1] | ~np.concatenate([[False], hit[:-1]]))
    last = hit & (np.append(heads[1:-1], True) | ~np.concatenate([hit[1:], [False]])) if len(hit) else hit
    begin, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return begin, end, np.diff(np.searchsorted(begin, found.first))


def _load(items: DataFrame, item_id: str, item_text: str, k: int) -> tuple[int, Iterator[Phrases]]:
    """Number of passes of a bounded size and the phrases of each, collected as it is asked for: items are dealt by a hash of their text."""
    texts = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where(F.col("t").isNotNull())
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = size // PASS_BYTES + 1
    return passes, (Phrases([(r.i, r.t) for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == p).collect()], k) for p in range(passes))


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """One row per document: ``keep`` columns, n_words, spans (array of start and end in words) and item_ids.

    A phrase is k consecutive words of an item, or all words of a shorter one. Null and empty
    texts have no words. Equal items and windows that several items share count for each.
    An item without an id still marks words but is not listed. Repeated rows stay repeated.
    """
    body = own_name(docs, "_body")
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(body))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def pass_over(phrases: Phrases, frame: DataFrame, nth: int, last: bool) -> DataFrame:
        """Adds what one pass finds; the text goes on only where another pass follows."""
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        carried = [c for c in frame.columns if not (last and c == body)]
        span = T.StructType(fields(start=LONG, end=LONG))
        added = fields(**{f"_words{nth}": LONG, f"_spans{nth}": T.ArrayType(span), f"_items{nth}": T.ArrayType(TEXT)})
        schema = T.StructType([frame.schema[c] for c in carried] + added)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            names = np.array([*phrases.names, ""], object)
            for batch, data, offsets in chunks(batches, body, SHARD_BYTES):
                found = W.find(data, offsets, W.ALNUM)
                hit, row, item = search_shard(found, phrases)
                begin, end, many = _spans(found, hit)
                base = np.repeat(found.first[:-1], many)
                span = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["start", "end"])
                ids = np.bincount(row, minlength=batch.num_rows)
                columns = [batch.column(c) for c in carried]
                columns += [pa.array(found.counts, pa.int64()), lists(span, many).cast(span_type), lists(pa.array(names[item], pa.string()), ids)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return frame.mapInArrow(run, schema)

    passes, loaded = _load(items, item_id, item_text, k)
    for nth, phrases in enumerate(loaded):
        frame = pass_over(phrases, frame, nth, nth == passes - 1)
    spans, found = F.col("_spans0"), F.col("_items0")
    if passes > 1:
        spans = _united(F.array_sort(F.concat(*[f"_spans{i}" for i in range(passes)])))
        found = F.array_distinct(F.concat(*[f"_items{i}" for i in range(passes)]))
    return frame.select(*[F.col(f"`{c}`") for c in keep], F.col("_words0").alias("n_words"), spans.alias("spans"), found.alias("item_ids"))


def _united(spans):
    """Sorted spans with those that touch made one."""

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """``docs`` with every merged removal span cut out of ``text``, from its first word to its last.

    Every pass searches the original text; the spans of all are cut at once at the end.
    Rows without a hit are returned as they are, null texts too. A text of which nothing
    but separators remains becomes empty.
    """
    passes, loaded = _load(items, item_id, item_text, k)
    before = own_name(docs, "_spans")
    frame, span_type = docs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    carried = T.StructType([*docs.schema, *fields(**{before: T.ArrayType(T.StructType(fields(start=LONG, end=LONG)))})])

    def pass_over(phrases: Phrases, frame: DataFrame, nth: int) -> DataFrame:
        """Unites its spans with those of the passes before; the last pass cuts."""
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch, data, offsets in chunks(batches, text, SHARD_BYTES):
                found = W.find(data, offsets, W.ALNUM)
                hit, _, _ = search_shard(found, phrases)
                if nth:
                    hit = hit | _marked(found, batch.column(before))
                    batch = batch.drop_columns([before])
                begin, end, many = _spans(found, hit)
                if nth < passes - 1:
                    base = np.repeat(found.first[:-1], many)
                    span = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["start", "end"])
                    yield batch.append_column(before, lists(span, many).cast(span_type))
                else:
                    yield _cut(batch, text, data, offsets, found, begin, end, many)

        return frame.mapInArrow(run, docs.schema if nth == passes - 1 else carried)

    for nth, phrases in enumerate(loaded):
        frame = pass_over(phrases, frame, nth)
    return frame


def _marked(found: W.Words, spans: pa.ListArray) -> np.ndarray:
    """The words that a column of spans, counted in words of each row, covers."""
    flat = spans.flatten()
    base = np.repeat(found.first[:-1], spans.value_lengths().to_numpy(zero_copy_only=False))
    edges = np.zeros(len(found.start) + 1, np.int64)
    np.add.at(edges, flat.field("start").to_numpy(zero_copy_only=False) + base, 1)
    np.add.at(edges, flat.field("end").to_numpy(zero_copy_only=False) + base, -1)
    return np.cumsum(edges[:-1]) > 0


def _cut(batch: pa.RecordBatch, text: str, data: np.ndarray, offsets: np.ndarray, found: W.Words, begin: np.ndarray, end: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """The batch with its spans cut out of ``text``."""
    if not len(begin):
        return batch
    column = batch.column(text).to_pylist()
    ends = np.cumsum(many)
    for row in np.flatnonzero(many):
        raw, base, at, parts = data[offsets[row] : offsets[row + 1]].tobytes(), offsets[row], 0, []
        for s in range(ends[row] - many[row], ends[row]):
            parts.append(raw[at : found.start[begin[s]] - base])
            at = found.end[end[s] - 1] - base
        left = b"".join([*parts, raw[at:]])
        column[row] = left.decode() if W.ALNUM[np.frombuffer(left, np.uint8)].any() else ""
    at = batch.schema.get_field_index(text)
    return batch.set_column(at, batch.schema.field(at), pa.array(column, batch.column(at).type))
