"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import LONG, TEXT, chunks, discard, fewer, fields, give_back, lists, own_name, text_bytes, written
from .components import connected, sides

U = np.uint64

#: Characters and features from which a line is compared with lines that are not equal to it.
LEAST_SIZE, LEAST_FEATURES = 20, 3

#: Lines of so many features or fewer have a SimHash for each feature left out, and those of TWO_OUT or fewer for each two.
ONE_OUT, TWO_OUT = 12, 9

#: Features from which a line's are dealt to 4, 8, 16, … classes; those of CLASSES_OVERLAP times a number or more are dealt to both.
CLASSES_FROM = [8, 24, 80, *(240 << i for i in range(14))]
CLASSES_OVERLAP = 0.93

#: Letters of the features that a block of a SimHash is made of at least (of 4 classes, of more), each counting up to 15; a
#: smaller class is joined by those behind it, so that a few very common words are no block.
LETTERS = (12, 18)

#: Words of more bytes are many features, one for each two characters side by side: text without blanks between words.
LONG_WORD = 24

#: Words that a line needs to be compared at all, unless the caller says otherwise; op4 and the pipeline compare all lines with a word.
LEAST_WORDS = 3

#: Lines of candidate pairs (16 bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000

#: Removed lines (8 bytes each, and 24 for their document) that are broadcast at most; beyond, all texts are shuffled to them.
BROADCAST_LINES = 2_000_000

CHUNK = 1_000_000

#: Lines of which one in so many is looked at to find the blocks that stand out, and how many of those are treated apart.
LOOK, HOT = 64, 1000

#: Shares that blocks are dealt to, blocks dealt in one go, and lines of a block from which its nodes are dealt to several shares.
SHARES, DEALT, PART = 1024, 1 << 18, 1 << 17

#: Places for lines of a task whose blocks are known, each for the latest of its hash; a line that was forgotten gives its blocks again.
LATEST = 1 << 18

#: Features of lines that are worked on at a time.
SIMHASH_FEATURES = 1 << 18

_ONE_DIGIT = np.arange(256, dtype=np.uint8)
_ONE_DIGIT[48:58] = 48


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of normalised lines (lower case, every digit 0, no punctuation); of each line with words: first word, row and number."""
    found = W.find(data, offsets, W.ALNUM)
    found = found._replace(data=_ONE_DIGIT[found.data])
    breaks = np.flatnonzero(data == 10)
    row = found.row
    line = np.searchsorted(breaks, found.start) - np.searchsorted(breaks, offsets[:-1])[row]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(fresh)
    return found, first, row[first], line[first]


def _bit_sums(bits: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many numbers of each run (head, size) have each of the 64 bits: plane j holds bit j of all 64 sums."""
    by = np.argsort(-size, kind="stable")
    head, size = head[by], size[by]
    most = int(size[0]) if len(size) else 0
    planes = np.zeros((max(1, most.bit_length()), len(size)), U)
    live = np.searchsorted(-size, -np.arange(1, most + 1), "right")
    for k, n in enumerate(live):
        carry = bits[head[:n] + k]
        for plane in planes[: (k + 1).bit_length()]:
            plane[:n], carry = plane[:n] ^ carry, plane[:n] & carry
    out = np.empty_like(planes)
    out[:, by] = planes
    return out


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, carry = np.zeros((max(len(a), len(b)) + 1, a.shape[1]), U), np.zeros(a.shape[1], U)
    for j in range(len(out)):
        x, y = (p[j] if j < len(p) else U(0) for p in (a, b))
        out[j], carry = x ^ y ^ carry, (x & y) | (carry & (x ^ y))
    return out


def _minus(a: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out, borrow = a.copy(), bits
    for plane in out:
        plane[:], borrow = plane ^ borrow, ~plane & borrow
    return out


def _signs(planes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHashes: the bits that more than half of the features have."""
    above, level, half = np.zeros(len(count), U), np.full(len(count), ~U(0)), (count // 2).astype(U)
    for j in reversed(range(max(len(planes), int(half.max(initial=0)).bit_length()))):
        limit = U(0) - ((half >> U(j)) & U(1))
        plane = planes[j] if j < len(planes) else U(0)
        above |= level & plane & ~limit
        level &= ~(plane ^ limit)
    return above


def _tagged(sim: np.ndarray, levels: int, which: np.ndarray, count: np.ndarray) -> np.ndarray:
    tag = (U(levels) << U(48)) | (which.astype(U) << U(24)) | count.astype(U)
    return W.mix(sim ^ W.mix(tag))


def _left_out(key: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, block) of short lines: the SimHash of all features, and of all but each one, and each two where enough letters stay."""
    line = np.repeat(np.arange(len(first)), count)
    bits = W.mix(key)
    sums = _bit_sums(bits, first, count)
    of, without, many = [np.arange(len(first)), line], [_signs(sums, count), _signs(_minus(sums[:, line], bits), count[line] - 1)], [count, count[line] - 1]
    letters = (key & U(15)).astype(np.int64)
    all_letters = np.bincount(line, letters, minlength=len(first))
    for n in range(4, TWO_OUT + 1):
        mine = np.flatnonzero(count == n)
        i, j = np.triu_indices(n, 1)
        its, i, j = np.repeat(mine, len(i)), (first[mine][:, None] + i).ravel(), (first[mine][:, None] + j).ravel()
        some = all_letters[its] - letters[i] - letters[j] >= LETTERS[0]
        its, i, j = its[some], i[some], j[some]
        left = _minus(_minus(sums[:, its], bits[i]), bits[j])
        of.append(its)
        without.append(_signs(left, count[its] - 2))
        many.append(count[its] - 2)
    of, without, many = np.concatenate(of), np.concatenate(without), np.concatenate(many)
    return of, _tagged(without, 0, np.zeros(len(of), np.int64), many)


def _by_class(key: np.ndarray, first: np.ndarray, count: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, block): the SimHash of each of 2^level classes of features, a class of too few letters joined by those behind it."""
    classes, least = 1 << level, LETTERS[level > 2]
    cell = np.repeat(np.arange(len(first)), count) * classes + ((key >> U(44 - level)) & U(classes - 1)).astype(np.int64)
    size = np.bincount(cell, minlength=len(first) * classes)
    letters = np.bincount(cell, (key & U(15)).astype(np.float64), minlength=len(size))
    sums = _bit_sums(W.mix(key), np.cumsum(size) - size, size)
    own, sim = np.arange(len(size)), _signs(sums, size)
    all_size, few = size.copy(), np.flatnonzero(letters < least)
    some, some_letters = sums[:, few], letters[few]
    for step in range(1, classes):
        if not len(few):
            break
        behind = few - few % classes + (few % classes + step) % classes
        some, some_letters = _plus(some, sums[:, behind]), some_letters + letters[behind]
        all_size[few] += size[behind]
        sim[few] = _signs(some, all_size[few])
        more = some_letters < least
        few, some, some_letters = few[more], some[:, more], some_letters[more]
    return own // classes, _tagged(sim, level, own % classes, all_size)


def blocks(h: np.ndarray, letters: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Pigeonhole blocks of the lines' SimHashes: (line, block), ordered by line, for features ``h`` of so many ``letters``, of ascending ``line``.

    The features of a line are dealt to 4 or more classes by their hash, and every class has a
    SimHash of its own. A changed word changes two classes at most, so two lines that differ in
    fewer words than half their classes share a block. Lines of a few features share one
    if one of them (of nine or fewer: two) was changed, put in or left out. The n-th
    occurrence of a feature in a line is another feature than the first.
    """
    counts = np.bincount(line, minlength=lines)
    ends = np.cumsum(counts)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, U))]
    a, low = 0, U((1 << 44) - 1)
    while a < lines:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SIMHASH_FEATURES, "right")))
        begin, end = (ends[a - 1] if a else 0), ends[b - 1]
        key = ((line[begin:end] - a).astype(U) << U(44)) | ((h[begin:end] >> U(24)) << U(4)) | np.minimum(letters[begin:end], 15).astype(U)
        key.sort()
        again = np.concatenate([[False], key[1:] == key[:-1]])
        if again.any():
            place = np.arange(len(key))
            nth = (place - np.maximum.accumulate(np.where(again, 0, place)))[again].astype(U)
            key[again] = (key[again] & ~low) | ((W.mix((key[again] & low) ^ W.mix(nth)) >> U(24)) << U(4)) | (key[again] & U(15))
            key.sort()
        count = counts[a:b]
        first = np.cumsum(count) - count
        low_level, high_level = (np.searchsorted(CLASSES_FROM, x, "right") + 1 for x in (count, count / CLASSES_OVERLAP))
        some = [(np.flatnonzero((count >= LEAST_FEATURES) & (count <= ONE_OUT)), 0)]
        some += [(np.flatnonzero((low_level == x) | (high_level == x)), x) for x in range(2, int(high_level.max(initial=0)) + 1)]
        for which, level in some:
            if not len(which):
                continue
            at = np.arange(int(count[which].sum())) + np.repeat(first[which] - np.concatenate([[0], np.cumsum(count[which])[:-1]]), count[which])
            mine, its_first = key[at] & low, np.concatenate([[0], np.cumsum(count[which])[:-1]])
            of, block = _by_class(mine, its_first, count[which], level) if level else _left_out(mine, its_first, count[which])
            out.append((which[of] + a, block))
        a = b
    of, block = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(of, kind="stable")
    return of[by], block[by]


def _features(found: W.Words, h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, letters, line) of each word, and of each two characters of words beyond LONG_WORD bytes."""
    wide = found.end - found.start > LONG_WORD
    if not wide.any():
        return h, found.end - found.start, line
    begins = np.flatnonzero((found.data & 0xC0) != 0x80)
    a, b = np.searchsorted(begins, found.start[wide]), np.searchsorted(begins, found.end[wide])
    many = np.maximum(b - a - 1, 1)
    at = np.arange(int(many.sum())) + np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    last = np.minimum(at + 2, np.repeat(b, many))
    ends = np.append(begins, len(found.data))[last]
    ends = np.minimum(ends, np.repeat(found.end[wide], many))
    value = np.concatenate([h[~wide], W.hashes(found.data, begins[at], ends)])
    letters = np.concatenate([(found.end - found.start)[~wide], ends - begins[at]])
    owner = np.concatenate([line[~wide], np.repeat(line[wide], many)])
    by = np.argsort(owner, kind="stable")
    return value[by], letters[by], owner[by]


def _nodes(found: W.Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: a hash of its words in order and a second one, from other hashes of the words; their word hashes, and the number of words."""
    h = W.hashes(found.data, found.start, found.end)
    count = np.diff(np.append(first, len(h)))
    place = (np.arange(len(h)) - np.repeat(first, count)).astype(U)
    both = []
    for word, step in ((h, U(0xD6E8FEB86659FD93)), (W.hashes(found.data, found.start, found.end, W.other_mix), U(0xE7037ED1A0B428DB))):
        value = W.mix(word + place * step)
        both.append((W.mix((np.add.reduceat(value, first) if len(first) else np.zeros(0, U)) + count.astype(U))).view(np.int64))
    return *both, h, count


def _sizes(found: W.Words, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Characters of each line, with one blank between its words."""
    begins = np.zeros(len(found.data) + 1, np.int32)
    np.cumsum((found.data & 0xC0) != 0x80, dtype=np.int32, out=begins[1:])
    length = begins[found.end] - begins[found.start]
    return (np.add.reduceat(length, first) if len(first) else length) + count - 1


def line_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Of docs (doc, print, body): one row per line that is compared (doc, print, line, node, check, size in characters, blocks).

    ``blocks`` is filled at the first of equal lines of a task (or again, if that is no longer remembered), and empty if the line is too
    short to be compared with others than its equals. Null keys go through; a null body has no line.
    """
    schema = T.StructType([docs.schema["doc"], *fields(print=LONG, line=LONG, node=LONG, check=LONG, size=T.IntegerType(), blocks=T.ArrayType(LONG))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest = np.zeros((2, LATEST), np.int64)
        for batch, data, offsets in chunks(batches, "body", CHUNK):
            found, first, row, line = _lines(data, offsets)
            node, check, h, count = _nodes(found, first)
            size = _sizes(found, first, count)
            some = np.flatnonzero(count >= least_words)
            fresh = np.zeros(len(first), bool)
            _, one, of = np.unique(node[some], return_index=True, return_inverse=True)
            fresh[some[one]] = True
            fresh[some] |= check[some] != check[some[one]][of]
            slot = node & (LATEST - 1)
            fresh &= (size >= LEAST_SIZE) & ((latest[0][slot] != node) | (latest[1][slot] != check))
            latest[0][slot[fresh]], latest[1][slot[fresh]] = node[fresh], check[fresh]
            number = np.cumsum(fresh) - 1
            its_line = np.repeat(np.arange(len(first)), count)
            h, letters, its_line = _features(found, h, its_line)
            used = fresh[its_line]
            of, block = blocks(h[used], letters[used], number[its_line[used]], int(fresh.sum()))
            many = np.zeros(len(first), np.int64)
            many[fresh] = np.bincount(of, minlength=int(fresh.sum()))
            at = pa.array(row[some])
            columns = [batch.column("doc").take(at), batch.column("print").take(at), *(pa.array(x[some].astype(np.int64)) for x in (line, node, check)), pa.array(size[some].astype(np.int32)), lists(pa.array(block.view(np.int64)), many[some])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


#: Bytes of a line as they are compared: A-Z small, digits 0, bytes beyond ASCII as they are, all else blank.
_NORMAL = bytes(int(_ONE_DIGIT[W.LOWER[b]]) if W.ALNUM[b] else 32 for b in range(256))


def _line_texts(docs: DataFrame) -> DataFrame:
    """Of docs (body, wanted): (node, body) of the wanted lines (line, node), their words with one blank between. A null body has no line."""
    schema = T.StructType(fields(node=LONG, body=TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("body"))
            wanted = batch.column("wanted")
            its, ends = wanted.flatten(), np.append(0, np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False)))
            raw, line, texts = data.tobytes(), its.field("line").to_pylist(), []
            for a, b, begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                lines = raw[a:b].split(b"\n")
                texts += [b" ".join(lines[n].translate(_NORMAL).split()) for n in line[begin:end]]
            yield pa.RecordBatch.from_arrays([its.field("node"), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.select("body", "wanted").mapInArrow(run, schema)


def _trimmed(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of both, the shorter first, without what both begin or end with."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in sorted((a, b), key=len))
    unlike = np.flatnonzero(x != y[: len(x)])
    start = int(unlike[0]) if len(unlike) else len(x)
    x, y = x[start:], y[start:]
    unlike = np.flatnonzero(x[::-1] != y[len(y) - len(x) :][::-1])
    end = int(unlike[0]) if len(unlike) else len(x)
    return x[: len(x) - end], y[: len(y) - end]


#: Cells of 64 rows that distances are computed with at a time, bytes of their tables of character places, and pairs of some length that it takes.
CELLS, PLACES_BYTES, TOGETHER = 4096, 16_000_000, 16


def _one_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance, bit-parallel: one column of any height per character of ``b``."""
    places: dict[int, int] = {}
    for c in np.unique(a).tolist():
        places[c] = int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little")
    mask, top, up, down, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for c in b.tolist():
        same = places.get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        grow, fall = down | (mask & ~(level | up)), up & level
        distance += bool(grow & top) - bool(fall & top)
        grow, fall = (grow << 1 | 1) & mask, (fall << 1) & mask
        up, down = fall | (mask & ~(vertical | grow)), grow & vertical
    return distance


def _columns(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The same of many pairs together, whatever their lengths: 64 rows of a pair are a cell, and in a step all cells go one column on.

    A cell is one column behind the cell above it, whose carries of the step before it takes.
    """
    rows, columns = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    words, n = -(-rows // 64), len(pairs)
    pair, head = np.repeat(np.arange(n), words), np.cumsum(words) - words
    block, cells = np.arange(len(pair)) - head[pair], len(pair)
    # the letters of each pair's first text and one number for all others; where they stand, for each cell
    owner, row = np.repeat(np.arange(n), rows), np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
    letters, code = np.unique((owner << 32) | np.concatenate([x for x, _ in pairs]), return_inverse=True)
    own = np.bincount(letters >> 32, minlength=n)
    low, size = np.cumsum(own) - own, own[pair] + 1
    base = np.cumsum(size) - size
    places = np.zeros(int(size.sum() + size.max()), U)
    np.add.at(places, base[head[owner] + (row >> 6)] + code - low[owner], U(1) << (row & 63).astype(U))
    owner = np.repeat(np.arange(n), columns)
    flat = (owner << 32) | np.concatenate([y for _, y in pairs])
    at = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    text = np.concatenate([np.zeros(int(words.max()), np.int64), np.where(letters[at] == flat, at - low[owner], own[owner])])
    # cells that end last come first, so those at work are always the first ones
    by = np.argsort(-(block + columns[pair]), kind="stable")
    place = np.empty(cells, np.int64)
    place[by] = np.arange(cells)
    above = np.where(block == 0, cells, place[np.arange(cells) - 1])[by]
    pair, block, base = pair[by], block[by], base[by]
    at, end = int(words.max()) + (np.cumsum(columns) - columns)[pair] - block, block + columns[pair]
    live = np.searchsorted(-end, -np.arange(int(end[0])), "left")
    begins = np.split(np.argsort(block, kind="stable"), np.cumsum(np.bincount(block))[:-1])
    up, down, grow, fall = np.full(cells, ~U(0)), np.zeros(cells, U), np.zeros(cells + 1, U), np.zeros(cells + 1, U)
    grow[cells], one, high = 1, U(1), U(63)
    for step, m in enumerate(live):
        if step < len(begins):
            up[begins[step]], down[begins[step]] = ~U(0), 0
        eq, inc, dec, pv, mv = places.take(base[:m] + text.take(at[:m])), grow.take(above[:m]), fall.take(above[:m]), up[:m], down[:m]
        at[:m] += 1
        vertical = eq | mv
        eq |= dec
        level = (((eq & pv) + pv) ^ pv) | eq
        more, less = mv | ~(level | pv), pv & level
        grow[:m], fall[:m] = more >> high, less >> high
        more_in, less_in = (more << one) | inc, (less << one) | dec
        up[:m], down[:m] = less_in | ~(vertical | more_in), more_in & vertical
    held = ~U(0) >> (64 - np.minimum(rows[pair] - 64 * block, 64)).astype(U)
    return columns + np.bincount(pair, np.bitwise_count(up & held).astype(np.int64) - np.bitwise_count(down & held).astype(np.int64), minlength=n).astype(np.int64)


#: Words that two lines may differ in at one place for ``_by_words`` to find where they go on alike.
APART = 12


def _by_words(a: str, b: str, most: float) -> float:
    """A bound that the distance of two texts of words does not exceed; more than ``most`` if none is found.

    Alike words are stepped over; where two differ, all up to the nearest two alike ones are
    replaced, each with its blank.
    """
    x, y = a.split(" "), b.split(" ")
    i = j = total = 0
    while i < len(x) and j < len(y) and total <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for apart in range(1, APART):
            di = next((d for d in range(apart + 1) if i + d < len(x) and j + apart - d < len(y) and x[i + d] == y[j + apart - d]), None)
            if di is not None:
                break
        else:
            return most + 1
        dj = apart - di
        total += max(sum(map(len, x[i : i + di])) + di, sum(map(len, y[j : j + dj])) + dj)
        i, j = i + di, j + dj
    return total + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


def _two_letters(text: np.ndarray) -> np.ndarray:
    return np.bincount((text[:-1] * np.uint32(31) + text[1:]) & np.uint32(255), minlength=256)


def edit_distances(a: list[str], b: list[str], enough: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distance of each pair.

    With ``enough``, a bound that does not exceed it stands for the distance where there is a
    cheap one, and a bound that does not fall below where that is more than ``enough``: an edit
    changes the length by one, and two pairs of letters side by side each.
    """
    out, rest = np.zeros(len(a), np.int64), []
    letters: dict[str, np.ndarray] = {}
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        if enough is not None:
            out[i] = abs(len(s) - len(t))
            if out[i] > enough[i]:
                continue
            out[i] = _by_words(s, t, enough[i])
            if out[i] <= enough[i]:
                continue
            for x in (s, t):
                if x not in letters:
                    letters[x] = _two_letters(np.frombuffer(x.encode("utf-32-le"), np.uint32))
            out[i] = -(-int(np.abs(letters[s] - letters[t]).sum()) // 4)
            if out[i] > enough[i]:
                continue
        x, y = _trimmed(s, t)
        out[i] = len(y)
        if not len(x) or (enough is not None and len(y) <= enough[i]):
            continue
        rest.append((i, x, y))
    rest.sort(key=lambda r: -len(r[2]))
    begin = 0
    while begin < len(rest):
        # a step of a few long pairs costs more together than one by one
        if begin + TOGETHER >= len(rest) or len(rest[begin][2]) > 2 * len(rest[begin + TOGETHER][2]):
            out[rest[begin][0]] = _one_distance(*rest[begin][1:])
            begin += 1
            continue
        end, cells, room = begin, 0, 0
        while end < len(rest):
            words = -(-len(rest[end][1]) // 64)
            # distinct letters of a pair: seldom more than 512
            cells, room = cells + words, room + words * 8 * min(512, len(rest[end][1]) + 1)
            if end > begin and (cells > CELLS or room > PLACES_BYTES):
                break
            end += 1
        some = [r[1:] for r in rest[begin:end]]
        out[[r[0] for r in rest[begin:end]]] = _columns(some)
        begin = end
    return out


def edit_distance(a: str, b: str) -> int:
    return int(edit_distances([a], [b])[0])


def meetings(lines: DataFrame) -> DataFrame:
    """Of lines (node, size, blocks) the blocks that several nodes have: (sig, node, size, leader, leader_size), the leader being the least of its nodes.

    Each block belongs to a share, by its hash. A task sends a share all it has for it as one row of numbers, not a row for each
    block, of which hardly one in twenty is shared. The nodes of the few blocks that one in LOOK of the lines shows as
    very large are dealt on, to a share for each PART of them: each part has a leader of its own, no row is lost.
    """
    some = fewer(lines).where(F.rand(1) * LOOK < 1).select(F.explode("blocks").alias("sig")).groupBy("sig").agg((F.count(F.lit(1)) * LOOK).alias("many"))
    large = sorted(tuple(r) for r in some.where(F.col("many") >= 2 * PART).orderBy(F.desc("many"), "sig").limit(HOT).collect())
    hot, parts = np.array([x for x, _ in large], np.int64), np.array([n // PART for _, n in large], U)
    held = ("sigs", "nodes", "sizes")
    packets = T.StructType(fields(share=T.IntegerType(), **dict.fromkeys(held, T.BinaryType())))
    found = T.StructType(fields(sig=LONG, node=LONG, size=T.IntegerType(), leader=LONG, leader_size=T.IntegerType()))

    def is_hot(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
        some = np.flatnonzero(hot[at] == sig)
        return some, at[some]

    def dealt(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        sig, node, size = (np.concatenate(x) for x in zip(*rows, strict=True))
        share = (sig.view(U) >> U(54)).astype(np.uint16)
        if len(hot):
            some, which = is_hot(sig)
            share[some] = (share[some] + W.mix(node[some].view(U)) % parts[which]) % U(SHARES)
        by = np.argsort(share, kind="stable")
        many = np.bincount(share, minlength=SHARES)
        which = np.flatnonzero(many)
        ends = np.concatenate([[0], np.cumsum(many[which])])
        columns = [pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x[by])]) for x in (sig, node, size)]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *columns], names=packets.names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for batch in batches:
            blocks = batch.column("blocks")
            many = blocks.value_lengths().to_numpy(zero_copy_only=False)
            rows.append((blocks.flatten().to_numpy(), *(np.repeat(batch.column(c).to_numpy(), many) for c in ("node", "size"))))
            total += len(rows[-1][0])
            if total >= DEALT:
                yield dealt(rows)
                rows, total = [], 0
        if total:
            yield dealt(rows)
        give_back()

    def met(share: list[pa.RecordBatch]) -> pa.RecordBatch:
        sig, node, size = (np.concatenate([text_bytes(x.column(c))[0].view(kind) for x in share]) for c, kind in zip(held, (np.int64, np.int64, np.int32), strict=True))
        by = np.argsort(sig)
        again = sig[by[1:]] == sig[by[:-1]]
        by = by[np.append(again, False) | np.append(False, again)] if not len(hot) else by
        by = by[np.lexsort((node[by], sig[by]))]
        sig, node, size = sig[by], node[by], size[by]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))[: len(sig)]
        sig, node, size = sig[fresh], node[fresh], size[fresh]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        many = np.diff(np.append(first, len(sig)))
        several = many > 1
        if len(hot):
            several[is_hot(sig[first])[0]] = True
        mine, lead = np.repeat(several, many), np.repeat(first, many)
        return pa.RecordBatch.from_arrays([pa.array(x[mine]) for x in (sig, node, size, node[lead], size[lead])], names=found.names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, now = [], None
        for batch in batches:
            its = batch.column("share").to_numpy()
            cuts = [0, *(np.flatnonzero(its[1:] != its[:-1]) + 1).tolist(), len(its)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if share and its[a] != now:
                        yield met(share)
                        share = []
                    now = its[a]
                    share.append(batch.slice(a, b - a))
        if share:
            yield met(share)
        give_back()

    shares = lines.select("node", "size", "blocks").mapInArrow(deal, packets).repartition("share").sortWithinPartitions("share")
    return written(shares.mapInArrow(meet, found), "meetings")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, body) of the nodes, from the documents that have their first occurrences."""
    places = nodes.select("node", F.col("first.doc").alias("its_doc"), F.col("first.print").alias("its_print"), F.struct("first.line", "node").alias("its_line"))
    wanted = written(places.groupBy("its_doc", "its_print").agg(F.collect_list("its_line").alias("wanted")), "wanted")
    few = F.broadcast(wanted) if (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_ROWS else wanted
    held = docs.join(few, F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("print") == F.col("its_print")))
    texts = written(_line_texts(held).groupBy("node").agg(F.first("body").alias("body")), "texts")
    discard(wanted)
    return texts


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines whose edit similarity, 1 - distance / longer length, reaches ``similarity``."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("body").alias(f"text_{name}"))
    schema = T.StructType(fields(a=LONG, b=LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            most = np.array([(1 - similarity) * max(len(s), len(t)) + 1e-9 for s, t in zip(x, y, strict=True)])
            yield batch.select(["a", "b"]).filter(pa.array(edit_distances(x, y, most) <= most))

    return written(fewer(pairs).join(side("a"), "a").join(side("b"), "b").mapInArrow(run, schema), "links")


def line_groups(docs: DataFrame, lines: DataFrame, nodes: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(node, group) of the lines (node, size, blocks) whose blocks others share: those that links connect are one group;
    and before it the ``nodes`` of these lines (met is true) and of those that stand in several places.

    Two lines link if they share a block and have the edit similarity. First every line is
    tried against one other, the least of those it shares a block with; then what is not
    connected, as ``connected`` does.
    """
    left, right = sides()
    sizes = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9
    met = meetings(lines)
    ends = written(fewer(met).select("node").distinct(), "ends")
    known = written(fewer(nodes).select("node", "first", "places").join(fewer(ends).withColumn("met", F.lit(True)), "node", "left").where("met or places > 1"), "known")
    texts = _texts(docs, fewer(known).where("met"))
    led = fewer(met).where((F.col("node") != F.col("leader")) & sizes(F.col("size"), F.col("leader_size")))
    links = _verified(texts, led.groupBy(F.col("node").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"), similarity)
    found = connected(met, ends, links, lambda pairs: _verified(texts, pairs, similarity), sizes(left("size"), right("size")), ["size"])
    discard(met, ends, texts)
    return known, found


def told_apart(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The line table with a node for each different line, and the nodes (node, size, first, places). ``lines`` is deleted if it is not returned.

    A line is known by two hashes of 64 bits, node and check. Where one node has several checks, all but the least get
    another node, made of both, until each node has one; there are hardly ever any, so later joins need the node alone.
    """
    place = F.struct("doc", "print", "line")
    while True:
        nodes = written(fewer(lines).groupBy("node").agg(F.max("size").alias("size"), F.min(place).alias("first"), F.count(F.lit(1)).alias("places"), F.min("check").alias("check"), F.max("check").alias("most")), "nodes")
        clash = nodes.where("check != most").select("node", F.col("check").alias("least"))
        many = clash.count()
        if not many:
            return lines, nodes
        joined = lines.join(F.broadcast(clash) if many <= BROADCAST_ROWS else clash, "node", "left")
        last, lines = lines, written(joined.withColumn("node", F.when(F.col("check") != F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))).select(*lines.columns), "lines")
        discard(last, nodes)


def keepers_of(docs: DataFrame, lines: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc, print, body) and their line table: the lines with nodes told apart, and (node, keeper) of lines that stand in several places.

    The keeper is the place (doc, print, line) that stays: the first of the connected group.
    """
    lines, nodes = told_apart(lines)
    known, found = line_groups(docs, lines, nodes, similarity)
    discard(nodes)
    grouped = fewer(known).join(fewer(found), "node", "left").select("node", "first", "places", F.coalesce("group", "node").alias("group"))
    first = grouped.groupBy("group").agg(F.min("first").alias("keeper"), F.count(F.lit(1)).alias("many"))
    keepers = written(grouped.join(first, "group").where("many > 1 or places > 1").select("node", "keeper"), "keepers")
    discard(known, found)
    return lines, keepers


def groups(docs: DataFrame, similarity: float = 0.8, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """``keepers_of`` the compared lines of docs (doc, print, body)."""
    return keepers_of(docs, written(line_table(docs, least_words), "lines"), similarity)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the lines gone of which an earlier occurrence stays, and columns lines and removed in front
    (with underscores behind the name where ``docs`` has such a column).

    Lines are compared as lower-cased words with every digit 0; lines of fewer than
    ``least_words`` words always stay, and lines without a word in any case. Two lines link when they
    share a block of their SimHashes (``blocks``) and their edit similarity reaches ``similarity``; lines of fewer than
    LEAST_SIZE characters or LEAST_FEATURES features link with equal ones only. Of each connected group the
    first occurrence by key, text hash and line stays. A null key comes first; rows that
    repeat key and text count as one and lose the same lines. Null texts stay null.
    """
    n_lines, n_removed = own_name(docs, "lines"), own_name(docs, "removed")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("print"), F.col(f"`{text}`").cast("string").alias("body"))
    lines, keepers = groups(named.select("doc", "print", "body"), similarity, least_words)
    again = fewer(lines).select("doc", "print", "line", "node").join(fewer(keepers), "node").where(~F.struct("doc", "print", "line").eqNullSafe(F.col("keeper")))
    gone = written(again.groupBy(F.col("doc").alias("gone_doc"), F.col("print").alias("gone_print")).agg(F.collect_set("line").alias("gone")), "gone")
    discard(lines, keepers)
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    joined = named.join(gone, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("print") == F.col("gone_print")), "left")
    joined = joined.withColumn("split", F.split("body", "\n", -1))
    # by a hash set, not by a search for each line
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("split").cast("long") - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("split", i.cast("int"))), "\n")
    kept = [F.when(F.col("gone").isNull(), F.col("body")).otherwise(rest).alias(c) if c == text else F.col(f"kept.`{c}`") for c in docs.columns]
    return joined.select(F.coalesce(F.size("split"), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_removed), *kept)
