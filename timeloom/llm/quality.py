"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import LONG, chunks, fields, lists, written
from .language_id import fold

U = np.uint64
DOUBLE = T.DoubleType()

#: Random features, width of the Gaussian kernel over standardised statistics, and ridge penalty.
FEATURES, GAMMA, RIDGE = 256, 0.05, 1e-3

#: Labelled rows that are learned from, about: those with the smallest hash.
TRAIN_ROWS = 40_000

#: Steps of a raw score for the calibration.
BINS = 512

CHUNK = 2_000_000

STATISTICS = ("bytes", "words", "word_size", "word_spread", "upper", "digit", "mark", "space", "line_breaks", "beyond_ascii", "distinct_words", "top_word", "distinct_lines", "short_words", "long_words", "bare_marks", "odd_signs", "exclaims", "line_size", "word_follows")


def _is(*chars: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _DIGIT, _SPACE, _BEYOND = _is(*range(65, 91)), _is(*range(48, 58)), _is(9, 10, 11, 12, 13, 32), _is(*range(128, 256))
_MARK = ~(W.ALNUM | _SPACE)
_ODD = _is(*b"#$%&*+<=>@\\^_`{|}~")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its number of different values, and how often its commonest stands there."""
    _, head, many = np.unique(W.mix(value ^ W.mix(row.astype(U) + U(1))), return_index=True, return_counts=True)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row[head], many)
    return np.bincount(row[head], minlength=rows), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    rows = len(offsets) - 1
    found = W.find(data, offsets, W.ALNUM)
    h, size, row, n = W.hashes(found.data, found.start, found.end), found.end - found.start, found.row, found.counts
    size_of = np.diff(offsets)
    b, w = np.maximum(size_of, 1), np.maximum(n, 1)
    mean = np.bincount(row, size, minlength=rows) / w
    spread = np.sqrt(np.maximum(np.bincount(row, size.astype(float) ** 2, minlength=rows) / w - mean**2, 0))
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, found.start) + row
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    texts = np.add.reduceat(W.mix(h ^ W.mix(place.astype(U) + U(1))), first) if len(first) else np.zeros(0, U)
    lines = np.maximum(np.bincount(row[first], minlength=rows), 1)
    different, top = _distinct(row, h, rows)
    whole, _ = _distinct(row[first], texts, rows)
    mark = _MARK[data]
    alone = mark.copy()
    alone[1:] &= mark[:-1] | _SPACE[data[:-1]]
    follows = np.zeros(len(data), bool)
    if len(found.end):
        behind = found.end[found.end < len(data)]
        follows[behind] = _SPACE[data[behind]]
    per = lambda flags, of: _per_row(flags, offsets) / of
    out = np.stack([
        np.log1p(size_of), np.log1p(n), mean, spread, per(_UPPER[data], b), per(_DIGIT[data], b), per(mark, b), per(_SPACE[data], b), per(data == 10, w), per(_BEYOND[data], b),
        different / w, top / w, whole / lines, np.bincount(row, size <= 3, minlength=rows) / w, np.bincount(row, size >= 12, minlength=rows) / w, per(alone, b), per(_ODD[data], w), per(data == 33, w), np.log1p(b / lines), per(follows, w),
    ], axis=1)
    return np.where((size_of > 0)[:, None], out, 0.0)


def statistics_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    schema = T.StructType([docs.schema[key], T.StructField("stats", T.ArrayType(DOUBLE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text, CHUNK):
            values = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(key), lists(pa.array(values.ravel()), np.full(len(values), len(STATISTICS)))], names=schema.names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores and their calibrated values
    values: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """The random Fourier features, and 1."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.phase), np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.lift(stats) @ self.weights, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated value; a hundredth of it is the raw score, which orders what one step holds."""
        raw = self.raw(stats)
        return 0.99 * np.interp(raw, self.steps, self.values) + 0.01 * raw if len(self.steps) else raw


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def isotonic(weight: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Rising values for consecutive bins, nearest to their means: neighbours in the wrong order are pooled."""
    pools: list[list[float]] = []
    for w, h in zip(weight, hits, strict=True):
        pools.append([w, h, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, h2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + w2, pools[-1][1] + h2, pools[-1][2] + n2]
    return np.concatenate([np.full(int(n), h / w) for w, h, n in pools]) if pools else np.zeros(0)


def train(stats: DataFrame, labels: DataFrame, key: str, label: str, rows: int = TRAIN_ROWS) -> Model:
    """Fits on labelled rows of folds other than 2; fold 3 calibrates. A key's labels are averaged, null ones left out.

    Without labelled rows every score is one half.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("mark"))
    labelled = written(stats.join(marks.where(fold(F.col(key)) != 2), key).select(fold(F.col(key)).alias("fold"), F.xxhash64(F.col(key).cast("string")).alias("h"), "stats", "mark"), "labelled")
    total = labelled.count()
    share = min(1.0, rows / max(1, total))
    labelled = labelled.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).coalesce(8)
    d = len(STATISTICS)
    each = [F.get("stats", F.lit(i)) for i in range(d)]
    summary = labelled.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    summary = np.array([x or 0.0 for x in summary])
    rng = np.random.default_rng(20_240)
    start = Model(summary[:d], np.maximum(summary[d:], 1e-6), rng.normal(0, np.sqrt(2 * GAMMA), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(0), np.zeros(0))
    upper = np.triu_indices(FEATURES + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = start.lift(_stats(batch))
            gram += z.T @ z
            moment += z.T @ batch.column("mark").to_numpy()
        flat = np.concatenate([gram[upper], moment])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "value"])

    cells = labelled.where("fold != 3").mapInArrow(sums, T.StructType(fields(cell=LONG, value=DOUBLE))).groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(len(upper[0]) + FEATURES + 1)
    flat[cells["cell"].to_numpy(np.int64)] = cells["value"].to_numpy(float)
    gram = np.zeros((FEATURES + 1, FEATURES + 1))
    gram[upper] = flat[: len(upper[0])]
    gram += np.triu(gram, 1).T
    count = gram[-1, -1]
    penalty = RIDGE * max(1.0, count) * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(gram + penalty, flat[len(upper[0]) :]) if count else np.append(np.zeros(FEATURES), 0.5)
    fitted = start._replace(weights=weights)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, hits = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.minimum((fitted.raw(_stats(batch)) * BINS).astype(int), BINS - 1)
            weight += np.bincount(at, minlength=BINS)
            hits += np.bincount(at, batch.column("mark").to_numpy(), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(weight), pa.array(hits)], names=["bin", "weight", "hits"])

    bins = labelled.where("fold = 3").mapInArrow(binned, T.StructType(fields(bin=LONG, weight=DOUBLE, hits=DOUBLE)))
    bins = bins.groupBy("bin").agg(F.sum("weight").alias("weight"), F.sum("hits").alias("hits")).where("weight > 0").orderBy("bin").toPandas()
    return fitted._replace(steps=(bins["bin"].to_numpy(float) + 0.5) / BINS, values=isotonic(bins["weight"].to_numpy(float), bins["hits"].to_numpy(float)))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: key and score from 0 to 1, higher where label 1 is likelier.

    Null texts count as empty; empty texts are scored by the statistics of an empty text.
    Repeated rows are scored one by one. A null key is scored but never learned from.
    """
    labels = labels.select(F.col(f"`{key}`"), F.col(f"`{label}`"))
    stats = written(statistics_table(docs, key, text), "statistics")
    model = train(stats, labels, key, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[key], T.StructField("score", DOUBLE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(shared.value.score(_stats(batch)))], names=schema.names)

    return stats.mapInArrow(run, schema)
