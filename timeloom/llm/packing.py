"""Best-fit packing: token pieces fill sequences by exact complements of one, two or three lengths, the rest by best fit."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, WORKER_CACHES, chunks, fields, own_name, written

#: Rows that are numbered in one task, about.
RANK_ROWS = 500_000

CHUNK = 1_000_000
CACHED_WORDS, CACHED_PARTS = 300_000, 600_000

#: Lower-case letters that no normaliser changes and that are one word to the tokenizer.
_LOW = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.islower())

#: Such letters, then ASCII marks other than the apostrophe, which begins contractions.
_PLAIN = re.compile(rf"([{_LOW}]+)([!-&(-/:-@\[-`{{-~]*)").fullmatch

#: The characters that byte-level vocabularies write bytes as: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_AS_BYTES = {ord(c): "".join(_BYTE_CHARS.get(b, chr(b)) for b in c.encode()) for c in _LOW if not c.isascii()}

#: Tokenizers and the ids of words met so far, by file, in each Python worker.
_LOADED: dict[str, tuple] = {}
WORKER_CACHES.append(_LOADED)


def _ids_of(path: str, texts: list[bytes], most_words: int = CACHED_WORDS, most_parts: int = CACHED_PARTS) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers.

    The tokenizer drops white space and no token reaches over it, so words between ASCII
    white space are encoded one by one and remembered. Plain words are lower-cased, and the marks
    behind their letters encoded apart, as the tokenizer does.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = (Tokenizer.from_file(path), {}, {})
    tokenizer, known, parts = _LOADED[path]
    for cache, most in ((known, most_words), (parts, most_parts)):
        if len(cache) > most:
            cache.clear()
    split = [t.split() for t in texts]
    new = [*set().union(*split).difference(known)]
    # words lower-cased together: none reaches over a blank, and a blank is no letter that another's form depends on
    said = b" ".join(new).decode()
    firsts, tails, plain, whole = [], [], set(), set()
    for text, low in zip(said.split(" "), said.lower().split(" "), strict=True):
        found = _PLAIN(low)
        letters, marks = found.groups() if found else (text, "")
        (plain if found else whole).add(letters)
        firsts.append(letters)
        tails.append(marks)
    whole.update(tails)
    whole.discard("")
    merge = tokenizer.model.tokenize
    for part in plain.difference(parts):
        parts[part] = array("I", [t.id for t in merge(part if part.isascii() else part.translate(_AS_BYTES))]).tobytes()
    rest = [*whole.difference(parts)]
    for part, found in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
        parts[part] = array("I", found.ids).tobytes()
    for word, first, marks in zip(new, firsts, tails):  # noqa: B905, of nothing new, the text is one empty word
        known[word] = parts[first] + parts[marks] if marks else parts[first]
    return [b"".join(map(known.__getitem__, words)) for words in split]


def tokenize(docs: DataFrame, path: str, keep: list[str], text: str = "text", length: int = 2048, end: int = 0, *, chunk: int = CHUNK, words: int = CACHED_WORDS, parts: int = CACHED_PARTS) -> DataFrame:
    """Pieces of at most ``length`` tokens: ``keep`` columns, piece, start, length and ids (32-bit little-endian).

    A document's ids end with ``end``; only longer documents are cut, every ``length``
    tokens. A null text is an empty one and has the end alone. Repeated rows give their
    pieces again. A Python worker encodes about ``chunk`` bytes of text at a time and remembers
    some ``words`` and ``parts`` of words: fewer take less memory and more time.
    """
    body = own_name(docs, "_body")
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(body))
    schema = T.StructType([*(frame.schema[c] for c in keep), *fields(piece=T.IntegerType(), start=LONG, length=LONG, ids=T.BinaryType())])
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, body, chunk, _LOADED):
            raw = data.tobytes()
            row, piece, start, cut = [], [], [], []
            for i, ids in enumerate(_ids_of(path, [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], words, parts)):
                ids += stop
                for at in range(0, len(ids), 4 * length):
                    row.append(i)
                    piece.append(at // (4 * length))
                    start.append(at // 4)
                    cut.append(ids[at : at + 4 * length])
            taken = pa.array(row, pa.int64())
            columns = [*(batch.column(c).take(taken) for c in keep), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(p) // 4 for p in cut], pa.int64()), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


class Plan:
    """Patterns of lengths, each for a number of sequences, from the number of pieces of every length."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.left = size, counts.astype(np.int64).copy()
        self.patterns: list[tuple[list[int], int]] = []
        for length in range(size, 0, -1):
            while self.left[length]:
                others = self._complement(length)
                if others is None:
                    break
                self._use([length, *others])
        self._best_fit()

    def _use(self, lengths: list[int]) -> None:
        kinds, each = np.unique(lengths, return_counts=True)
        times = int((self.left[kinds] // each).min())
        self.left[kinds] -= each * times
        self.patterns.append((lengths, times))

    def _has(self, length: int, taken: list[int]) -> bool:
        return 0 < length <= self.size and self.left[length] > taken.count(length)

    def _pair(self, total: int, taken: list[int]) -> list[int] | None:
        """Two available lengths of this sum, the larger one as large as can be."""
        free = self.left[: total + 1].copy() if total > 0 else np.zeros(1, np.int64)
        for length in taken:
            if length < len(free):
                free[length] -= 1
        free[0] = 0
        both = (free > 0) & (free[::-1] > 0)
        if total > 0 and total % 2 == 0 and free[total // 2] < 2:
            both[total // 2] = False
        found = np.flatnonzero(both)
        return [int(found[-1]), total - int(found[-1])] if len(found) else None

    def _complement(self, length: int) -> list[int] | None:
        """One, two or three available lengths that fill the rest of a sequence exactly; nothing for a full one."""
        gap, taken = self.size - length, [length]
        if not gap:
            return []
        if self._has(gap, taken):
            return [gap]
        if (found := self._pair(gap, taken)) is not None:
            return found
        for third in np.flatnonzero(self.left[:gap])[::-1]:
            third = int(third)
            if self._has(third, taken) and (found := self._pair(gap - third, [*taken, third])) is not None:
                return [third, *found]
        return None

    def _best_fit(self) -> None:
        """The remaining pieces, from the longest: into the open sequences with the least room that is enough."""
        rooms: dict[int, list[tuple[list[int], int]]] = {}
        for length in range(self.size, 0, -1):
            while self.left[length]:
                room = min((r for r in rooms if r >= length), default=None)
                if room is None:
                    fits = max(1, self.size // length)
                    whole, rest = divmod(int(self.left[length]), fits)
                    for pieces, times in ((fits, whole), (rest, 1)):
                        if pieces and times:
                            rooms.setdefault(self.size - pieces * length, []).append(([length] * pieces, times))
                    self.left[length] = 0
                    continue
                lengths, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                used = min(times, int(self.left[length]))
                rooms.setdefault(room - length, []).append(([*lengths, length], used))
                if used < times:
                    rooms.setdefault(room, []).append((lengths, times - used))
                self.left[length] -= used
        self.patterns += [x for found in rooms.values() for x in found]

    def slots(self) -> tuple[np.ndarray, ...]:
        """By length and place among the pieces of that length: first place, first sequence, and offset in it."""
        rows, sequence, used = [], 0, {}
        for lengths, times in self.patterns:
            offset = 0
            for length in lengths:
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
            sequence += times
        return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack(pieces: DataFrame, size: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset: every sequence is filled from 0 without a gap, up to ``size``.

    Lengths have to lie between 1 and ``size``. The plan is made from the number of pieces of
    each length, so its size does not depend on the corpus. Pieces of one length take its
    places in the order of the columns ``order`` within each of many dealt parts, so a length that many pieces have is
    numbered by many tasks; how many stand in the parts before is a table that is joined by length and part. Repeated and null ids are pieces like any other.
    """
    pieces = written(pieces, "pieces")
    parts = int(pieces.count() // RANK_ROWS) + 16
    part, rank, before = own_name(pieces, "_part"), own_name(pieces, "_rank"), own_name(pieces, "_before")
    dealt = pieces.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)))
    counted = written(dealt.groupBy(F.col(length).alias("of_length"), F.col(part).alias("of_part")).agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = np.zeros(size + 1, np.int64)
    for row in counted.groupBy("of_length").agg(F.sum("n").alias("n")).collect():
        counts[row.of_length] = row.n
    shared = pieces.sparkSession.sparkContext.broadcast(Plan(counts, size).slots())
    numbered = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(length, part).orderBy(*order)))
    earlier = counted.select("of_length", "of_part", (F.sum("n").over(Window.partitionBy("of_length").orderBy("of_part")) - F.col("n")).alias(before))
    numbered = numbered.join(earlier, (F.col(length) == F.col("of_length")) & (F.col(part) == F.col("of_part")))
    schema = T.StructType([*pieces.schema.fields, *fields(sequence_id=LONG, offset=LONG)])
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, places, sequences, offsets = shared.value
        key = (lengths << 40) | places
        for batch in batches:
            own = batch.column(length).to_numpy().astype(np.int64)
            place = batch.column(before).to_numpy() + batch.column(rank).to_numpy() - 1
            at = np.searchsorted(key, (own << 40) | place, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequences[at] + place - places[at]), pa.array(offsets[at])], names=schema.names)

    return numbered.mapInArrow(run, schema)
