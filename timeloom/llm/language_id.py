"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import LONG, TEXT, chunks, fields, lists, own_name

U = np.uint64

#: Byte n-grams of a word (with its borders) are counted in 2^BUCKET_BITS buckets.
BUCKET_BITS = 15
ORDERS = (1, 2, 3, 4)

#: Training texts of each language at most: those with the smallest hash.
TRAIN_ROWS = 4_000

#: What a change of language costs, in nats.
SWITCH = 6.0

CHUNK = 3_000_000
DISTINCT_WORDS = 200_000

#: First code points of script ranges and their scripts (fixed values of the Unicode standard).
SCRIPTS = [(0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xE00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x3040, "Kana"), (0x3400, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other")]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # log-probability by order, bucket and language
    scripts: np.ndarray  # script x language: whether a language's training words use it


def fold(column: Column) -> Column:
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(4))


def _gram_buckets(found: W.Words, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the given words, by order: (order, word, bucket) of each byte n-gram; 0 stands for a border."""
    size = (found.end - found.start)[words] + 2
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(at[-1]) - at[:-1][owner]
    edge = (place == 0) | (place == size[owner] - 1)
    data = np.where(edge, 0, found.data[np.where(edge, 0, found.start[words][owner] + place - 1)] if len(found.data) else 0).astype(U)
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            continue
        value = np.full(n, order, U)
        for i in range(order):
            value = (value << U(8)) | data[i : n + i]
        inside = np.flatnonzero(place[:n] + order <= size[owner[:n]])
        yield order, owner[inside], (W.mix(value[inside]) >> U(64 - BUCKET_BITS)).astype(np.int64)


def word_scripts(found: W.Words, words: np.ndarray) -> np.ndarray:
    """The script of each word's first letter; -1 for a word without letters."""
    out = np.full(len(words), -1)
    first = found.data[found.start[words]] if len(words) else np.zeros(0, np.uint8)
    latin = (first >= 97) & (first <= 122)
    out[latin] = _NAMES.index("Latin")
    for i in np.flatnonzero(~latin):
        for c in found.data[found.start[words[i]] : found.end[words[i]]].tobytes().decode("utf-8", "replace"):
            if unicodedata.category(c)[0] == "L":
                out[i] = _SCRIPT_OF[max(0, np.searchsorted(_STARTS, ord(c), "right") - 1)]
                break
    return out


def train(docs: DataFrame, key: str, text: str, lang: str, rows: int = TRAIN_ROWS) -> Model:
    """Counts of byte n-grams by language, over rows with a language whose fold is not 2.

    At most ``rows`` texts of each language are learned from; a language needs one row.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 2))
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("body"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    share = F.lit(None).cast("double")
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, rows / totals[name])).otherwise(share)
    known = known.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "body")
    schema = T.StructType(fields(lang=TEXT, kind=LONG, bucket=LONG, n=LONG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {name: np.zeros((len(ORDERS), 1 << BUCKET_BITS), np.int64) for name in languages}
        used = {name: np.zeros(len(_NAMES), np.int64) for name in languages}
        for batch, data, offsets in chunks(batches, "body", CHUNK):
            found = W.find(data, offsets, W.ALNUM)
            names = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])[found.row]
            for n, name in enumerate(languages):
                mine = np.flatnonzero(names == n)
                _, head, many = np.unique(W.hashes(found.data, found.start[mine], found.end[mine]), return_index=True, return_counts=True)
                for order, word, bucket in _gram_buckets(found, mine[head]):
                    counts[name][ORDERS.index(order)] += np.bincount(bucket, many[word], minlength=1 << BUCKET_BITS).astype(np.int64)
                script = word_scripts(found, mine[head])
                used[name] += np.bincount(script[script >= 0], many[script >= 0], minlength=len(_NAMES)).astype(np.int64)
        for name in languages:
            for kind, values in [*enumerate(counts[name]), (len(ORDERS), used[name])]:
                some = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array([kind] * len(some), pa.int64()), pa.array(some), pa.array(values[some])], names=schema.names)

    summed = known.mapInArrow(run, schema).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(ORDERS) + 1, 1 << BUCKET_BITS, len(languages)))
    counts[summed["kind"].to_numpy(np.int64), summed["bucket"].to_numpy(np.int64), [languages.index(x) for x in summed["lang"]]] = summed["n"].to_numpy(float)
    grams = counts[: len(ORDERS)] + 0.5
    scripts = counts[len(ORDERS), : len(_NAMES)]
    weights = np.log(grams / grams.sum(axis=1, keepdims=True)) if languages else grams
    return Model(languages, weights.astype(np.float32), scripts >= np.maximum(1, 0.001 * scripts.sum(axis=0)))


def word_scores(model: Model, found: W.Words, words: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word by language, as the mean over orders; 0 for all if it has no letter.

    Languages that do not use the word's script are ruled out, unless none uses it.
    """
    out = np.zeros((len(words), len(model.languages)), np.float32)
    for order, word, bucket in _gram_buckets(found, words):
        weight = model.weights[ORDERS.index(order)][bucket]
        for n in range(len(model.languages)):
            out[:, n] += np.bincount(word, weight[:, n], minlength=len(words))
    script = word_scripts(found, words)
    allowed = model.scripts[np.maximum(script, 0)]
    out = np.where(allowed | ~allowed.any(axis=1, keepdims=True), out / len(ORDERS), -1e4)
    return np.where((script >= 0)[:, None], out, 0).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: the rows of ``first`` go forward together, the longest first."""
    counts = np.diff(first)
    by = np.argsort(-counts, kind="stable")
    starts, sizes = first[:-1][by], counts[by]
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    came = np.zeros(scores.shape, np.int16)
    value = np.zeros((active[0], scores.shape[1]), np.float32)
    for t, n in enumerate(active):
        value = value[:n]
        at = starts[:n] + t
        if t:
            best = value.argmax(axis=1)
            top = value[np.arange(n), best][:, None] - np.float32(penalty)
            came[at] = np.where(value >= top, np.arange(scores.shape[1], dtype=np.int16), best[:, None])
            value = np.maximum(value, top)
        value = value + scores[at]
        over = np.arange(active[t + 1] if t + 1 < len(active) else 0, n)
        label[at[over]] = value[over].argmax(axis=1)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        label[at - 1] = came[at, label[at]]
    return label


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """One row per document: ``keep`` columns, lang_pred, score and spans (language, first word, word behind the last),
    these three with underscores behind the name where ``keep`` has it.

    lang_pred is the language with most bytes of words; score is its share of the bytes of
    all words with letters. Null texts and texts without a letter are ``und`` with score 0
    and no span, as is everything if the model has learned no language. Of equal languages
    the first by name wins. Repeated rows are judged one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType(fields(lang=TEXT, start=LONG, end=LONG))
    taken = docs.select(*[F.col(f"`{c}`") for c in keep])
    found_types = zip(("lang_pred", "score", "spans"), (TEXT, T.DoubleType(), T.ArrayType(span)), strict=True)
    schema = T.StructType([*taken.schema, *(T.StructField(own_name(taken, c), kind) for c, kind in found_types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        k = len(model.languages)
        seen, seen_scores, seen_letters = np.zeros(0, U), np.zeros((0, k), np.float32), np.zeros(0, bool)
        for batch, data, offsets in chunks(batches, text, CHUNK):
            found = W.find(data, offsets, W.ALNUM)
            distinct, head, which = np.unique(W.hashes(found.data, found.start, found.end), return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(seen, distinct), max(0, len(seen) - 1))
            old = seen[at] == distinct if len(seen) else np.zeros(len(distinct), bool)
            score, letters = np.zeros((len(distinct), k), np.float32), np.zeros(len(distinct), bool)
            score[old], letters[old] = seen_scores[at[old]], seen_letters[at[old]]
            fresh = head[~old]
            score[~old], letters[~old] = word_scores(model, found, fresh), word_scripts(found, fresh) >= 0
            if len(seen) + len(fresh) <= DISTINCT_WORDS:
                seen, seen_scores, seen_letters = np.concatenate([seen, distinct[~old]]), np.concatenate([seen_scores, score[~old]]), np.concatenate([seen_letters, letters[~old]])
                by = np.argsort(seen)
                seen, seen_scores, seen_letters = seen[by], seen_scores[by], seen_letters[by]
            label = viterbi(score[which], found.first, penalty) if k else np.zeros(len(which), np.int16)
            row, size = found.row, (found.end - found.start) * letters[which]
            mass = np.bincount(row * max(k, 1) + label, size, minlength=batch.num_rows * max(k, 1)).reshape(batch.num_rows, -1)
            total = mass.sum(axis=1)
            best = np.where((total > 0) & (k > 0), mass.argmax(axis=1), k)
            share = np.where(best < k, mass.max(axis=1) / np.maximum(total, 1), 0.0)
            edge = np.ones(len(row), bool)
            edge[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
            known = best[row] < k
            begin = np.flatnonzero(edge & known)
            last = np.append(edge[1:], True) if len(edge) else edge
            end = np.flatnonzero(last & known) + 1
            base = found.first[:-1][row[begin]]
            spans = pa.StructArray.from_arrays([pa.array(names[label[begin]], pa.string()), pa.array(begin - base), pa.array(end - base)], ["lang", "start", "end"])
            columns = [*(batch.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(share, pa.float64()), lists(spans, np.bincount(row[begin], minlength=batch.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    wanted = [*keep, *([] if text in keep else [text])]
    return docs.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)
