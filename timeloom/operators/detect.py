"""Faults in timed words (rec, idx, w, start_ms, end_ms, p_milli): fillers, unsure words, dead air, repeats, mangled names."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.functions import constants as C
from timeloom.functions import text as t

FLAGS = ["rec", "kind", "idx", "start_ms", "end_ms", "p_milli", "detail"]


def gaps(words: DataFrame) -> DataFrame:
    """Words with ``gap``, the time since the word before; null for the first."""
    order = Window.partitionBy("rec").orderBy("idx")
    return words.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(order))


def dead_air(words: DataFrame, least: int = 900) -> DataFrame:
    """Gaps longer than ``least``, as flags that begin where the word before ends."""
    rows = gaps(words).where(F.col("gap") > least)
    return rows.select("rec", F.lit("gap").alias("kind"), "idx", (F.col("start_ms") - F.col("gap")).alias("start_ms"), F.col("start_ms").alias("end_ms"), F.lit(None).cast("long").alias("p_milli"), F.lit("dead air").alias("detail"))


def faults(words: DataFrame, hard: list[str] = C.HARD_FILLERS, soft: list[str] = C.SOFT_FILLERS, stop: list[str] = C.STOP_WORDS, low: int = 450, gap: int = 900) -> DataFrame:
    """Flags of one word each (filler, soft_filler, low_conf) and of dead air; a word can be unsure besides being a filler.

    A hard filler counts as such even where the soft list has it, too. Stop words, words of
    fewer than three letters and a recording's first and last word are never unsure. One window over
    neighbouring words serves all flags.
    """
    order = Window.partitionBy("rec").orderBy("idx")
    rows = words.select("rec", "idx", "start_ms", "end_ms", "p_milli", t.norm(F.col("w")).alias("n"))
    rows = rows.withColumns({"gap": F.col("start_ms") - F.lag("end_ms").over(order), "last": F.lead(F.lit(True)).over(order).isNull()})
    flag = lambda kind, start, end, p, detail: F.struct(kind.alias("kind"), "idx", start.alias("start_ms"), end.alias("end_ms"), p.alias("p_milli"), detail.alias("detail"))
    kind = F.when(F.col("n").isin(hard), "filler").when(F.col("n").isin(soft), "soft_filler")
    unsure = (F.col("p_milli") < low) & ~F.col("n").isin(stop) & (F.length("n") >= 3) & (F.col("idx") > 0) & ~F.col("last")
    word = [F.col(c) for c in ("start_ms", "end_ms", "p_milli", "n")]
    dead = flag(F.lit("gap"), F.col("start_ms") - F.col("gap"), F.col("start_ms"), F.lit(None).cast("long"), F.lit("dead air"))
    flags = F.array_compact(F.array(F.when(kind.isNotNull(), flag(kind, *word)), F.when(unsure, flag(F.lit("low_conf"), *word)), F.when(F.col("gap") > gap, dead)))
    return rows.select("rec", F.explode(flags).alias("f")).select("rec", "f.*").select(*FLAGS)


def repeat_candidates(words: DataFrame, longest: int = 4, reach: int = 600, hard: list[str] = C.HARD_FILLERS) -> DataFrame:
    """(rec, idx, n): places where n words stand twice in a row, fillers apart, whether or not they overlap others.

    Keys ignore contraction endings; empty keys never match, and single words that are
    doubled for emphasis are no repeat. The copies are at most ``reach`` apart.
    """
    return _phrases(words, longest, reach, hard).select("rec", "idx", F.explode("ns").alias("n"))


def _phrases(words: DataFrame, longest: int, reach: int, hard: list[str]) -> DataFrame:
    """(rec, idx, place, following, ns): words that are no hard filler and begin a repeat, the idx of as many words from there as the longest has, and the lengths of the repeats.

    A word has a bit for each distance at which its key stands again, so a phrase of n words is the bit n of n words in a row. A
    recording's words stay together and in order in one partition, which is dealt once.
    """
    order = Window.partitionBy("rec").orderBy("idx")
    # exploded, so that the filter does not work a word's form out a second time
    rows = words.select("rec", "idx", "start_ms", "end_ms", F.explode(F.array(t.norm(F.col("w")))).alias("norm")).where(~F.col("norm").isin(hard))
    rows = rows.select("rec", "idx", "start_ms", "end_ms", t.without_contraction(F.col("norm")).alias("key")).repartition("rec")
    again = [F.when((F.col("key") != "") & (F.col("key") == F.lead("key", n).over(order)), F.lit(1 << n)).otherwise(0) for n in range(1, longest + 1)]
    near = F.when(F.lead("start_ms").over(order) - F.col("end_ms") <= reach, F.lit(True)).otherwise(False)
    calm = F.when(~F.col("key").isin(C.RHETORICAL), F.lit(~0)).otherwise(~2)
    rows = rows.select("rec", "idx", reduce(Column.bitwiseOR, again).alias("bits"), near.alias("near"), calm.alias("calm"))
    after = lambda c, n: F.lead(c, n).over(order) if n else F.col(c)
    tests, bits = [], F.lit(~0)
    for n in range(1, longest + 1):
        bits = bits.bitwiseAND(after("bits", n - 1))
        own = bits.bitwiseAND(F.col("calm")) if n == 1 else bits
        tests.append(F.when((own.bitwiseAND(F.lit(1 << n)) != 0) & after("near", n - 1), F.lit(n)))
    following = F.array(*[after("idx", n) for n in range(longest)])
    found = rows.select("rec", "idx", (F.row_number().over(order) - 1).cast("long").alias("place"), following.alias("following"), F.array_compact(F.array(*tests)).alias("ns"))
    return found.where(F.size("ns") > 0)


def repeats(words: DataFrame, longest: int = 4, reach: int = 600, hard: list[str] = C.HARD_FILLERS) -> DataFrame:
    """(rec, idx): words of first copies that go. Scans left to right, the longest phrase first, and goes on behind the first copy.

    Candidates are scanned where they are, in the order of their recordings; a task holds one batch of them and where the last phrase ended.
    """
    rows = _phrases(words, longest, reach, hard).select("rec", "place", F.array_max("ns").alias("n"), "following").sortWithinPartitions("rec", "place")
    schema = rows.select("rec", "n", "following").schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, free = None, 0
        for batch in batches:
            taken = []
            for at, (rec, place, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rec", "place", "n")), strict=True)):
                if rec != last or place >= free:
                    last, free = rec, place + n
                    taken.append(at)
            yield batch.take(pa.array(taken, pa.int64())).select(["rec", "n", "following"])

    return rows.mapInArrow(scan, schema).select("rec", F.explode(F.slice("following", F.lit(1), F.col("n"))).alias("idx"))


#: Longest string whose places fit the bits of a mask, and pairs that are compared at once.
MASK_BITS, PAIRS_AT_ONCE = 63, 4096


def _bits(ends: np.ndarray) -> np.ndarray:
    """Masks of the places before each end."""
    return (np.uint64(1) << ends.astype(np.uint64)) - np.uint64(1)


def _matched(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, floor: float) -> np.ndarray:
    """Characters in the matching blocks of pairs (rows of code points), or 0 where the longest common subsequence shows that the ratio stays below ``floor``.

    A place of ``a`` has a mask of the places of ``b`` with the same character. A round takes the longest common run of each part
    of a pair, the first in ``a``, then in ``b``, as ``difflib`` does, and goes on with what lies before and behind it.
    """
    same = np.zeros((int(la.max(initial=0)), len(a)), np.uint64)
    for j in range(int(lb.max(initial=0))):
        same |= (a.T[: len(same)] == b[:, j]).astype(np.uint64) << np.uint64(j)
    same &= np.where(np.arange(len(same))[:, None] < la, _bits(lb), np.uint64(0))
    rest = np.full(len(a), ~np.uint64(0))
    for row in same:
        rest = (rest + (rest & row)) | (rest & ~row)
    able = 2 * np.bitwise_count(~rest & _bits(lb)).astype(np.int64) >= floor * (la + lb) - 1e-9
    out = np.zeros(len(a), np.int64)
    pair = np.flatnonzero(able)
    a0, a1, b0, b1 = np.zeros_like(pair), la[pair], np.zeros_like(pair), lb[pair]
    while len(pair):
        at = np.arange(len(same))[:, None]
        part = np.where((at >= a0) & (at < a1), same[:, pair] & _bits(b1) & ~_bits(b0), np.uint64(0))
        size, first, second = (np.zeros_like(pair) for _ in range(3))
        live, runs, n = np.arange(len(pair)), part, 0
        while n < len(same):
            some = runs.any(axis=0)
            live, runs = live[some], runs[:, some]
            if not len(live):
                break
            n += 1
            i = (runs != 0).argmax(axis=0)
            low = runs[i, np.arange(len(live))]
            size[live], first[live], second[live] = n, i, np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
            runs = runs[:-1] & (part[n:, live] >> np.uint64(n))
        np.add.at(out, pair, size)
        parts = [(pair, a0, first, b0, second), (pair, first + size, a1, second + size, b1)]
        pair, a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*[[c[(size > 0) & (p[2] > p[1]) & (p[4] > p[3])] for c in p] for p in parts], strict=True))
    return out


def ratio_from(floor: float):
    """A column function: the Ratcliff-Obershelp similarity of two strings, or 0 where it is below ``floor``."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = (np.array([x or "" for x in c], object) for c in (a, b))
        la, lb = (np.array([len(x) for x in c], np.int64) for c in (a, b))
        out = np.ones(len(a))
        order = np.argsort((la << 32) + lb, kind="stable")
        fits = np.maximum(la, lb)[order] <= MASK_BITS
        for i in order[~fits]:
            out[i] = difflib.SequenceMatcher(None, a[i], b[i]).ratio()
        short = order[fits & ((la + lb)[order] > 0)]
        for start in range(0, len(short), PAIRS_AT_ONCE):
            some = short[start : start + PAIRS_AT_ONCE]
            codes = [c[some].astype("U").view(np.uint32).reshape(len(some), -1) for c in (a, b)]
            out[some] = 2.0 * _matched(*codes, la[some], lb[some], floor) / (la + lb)[some]
        return pd.Series(np.where(out >= floor, out, 0.0))

    return ratio


#: Ratcliff-Obershelp similarity of two strings.
seq_ratio = ratio_from(0.0)


def letters(word: Column) -> Column:
    """Two bits for each of 31 classes of characters: whether a word has one of the class, and whether several."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    codes = F.transform(F.split(word, ""), lambda c: F.pmod(F.ascii(c), F.lit(31)))
    once = F.aggregate(codes, F.lit(0).cast("long"), lambda seen, c: seen.bitwiseOR(bit(c)))
    again = lambda seen, c: F.when(seen["last"] == c, seen["bits"].bitwiseOR(bit(c + 31))).otherwise(seen["bits"])
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("bits"))
    twice = F.aggregate(F.array_sort(codes), start, lambda seen, c: F.struct(c.alias("last"), again(seen, c).alias("bits")), lambda seen: seen["bits"])
    return once.bitwiseOR(twice)


def may_reach(a: Column, b: Column, letters_a: Column, letters_b: Column, floor: float) -> Column:
    """Whether the sequence ratio of two words can be ``floor`` or more: each bit that differs is a character without a partner."""
    both = F.length(a) + F.length(b)
    return (2 * F.least(F.length(a), F.length(b)) >= floor * both - 1e-9) & (F.bit_count(letters_a.bitwiseXOR(letters_b)) <= (1 - floor) * both + 1e-9)


def dealt(words: DataFrame, key: str) -> DataFrame:
    """Few bytes but much work each: over several tasks a core, which adaptive execution would make one."""
    return words.repartition(4 * max(8, words.sparkSession.sparkContext.defaultParallelism), key)


def near_words(some: DataFrame, others: DataFrame, floor: float) -> DataFrame:
    """(a, b, ratio): pairs of different words, a of ``some`` (word), which is broadcast, and b of ``others`` (word), whose ratio reaches ``floor``.

    The words of a pair are compared in their order. A pair of which both words stand in both tables comes once, a before b.
    Candidates are all that lengths and letter counts leave possible.
    """
    some = some.distinct().select(F.col("word").alias("a"), letters(F.col("word")).alias("la"))
    rows = dealt(others.distinct(), "word").select(F.col("word").alias("b"), letters(F.col("word")).alias("lb"))
    rows = rows.join(F.broadcast(some.select(F.col("a").alias("b"), F.lit(True).alias("in_some"))), "b", "left").where(F.col("b").isNotNull())
    reach = F.explode(F.sequence(F.ceil(F.length("a") * floor / (2 - floor) - 1e-9), F.floor(F.length("a") * (2 - floor) / floor + 1e-9)))
    keyed = F.broadcast(some.where("length(a) > 0").select("a", "la", reach.alias("size")))
    fits = (F.col("a") != F.col("b")) & (F.col("in_some").isNull() | (F.col("a") < F.col("b"))) & may_reach(F.col("a"), F.col("b"), F.col("la"), F.col("lb"), floor)
    pairs = rows.withColumn("size", F.length("b").cast("long")).join(keyed, "size").where(fits).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b")
    return pairs.withColumn("ratio", ratio_from(floor)("x", "y")).where(F.col("ratio") >= floor).select("a", "b", "ratio")


def mangled_names(words: DataFrame, lexicon: DataFrame, dictionary: DataFrame, floor: float = 0.65, known_floor: float = 0.80, ceiling: float = 0.97, gate: int = 550) -> DataFrame:
    """(rec, idx, term, ratio): words that are nearly a lexicon term (ord, term), from distinct tokens only.

    A dictionary word (``dictionary`` has one column, word) is a candidate only below the
    confidence ``gate`` and from ``known_floor`` on. A plural or tense of any term is no miss.
    The lexicon is broadcast; it is a word list by contract. Candidates are all pairs that
    lengths and letter counts leave possible.
    """
    terms = lexicon.select("ord", t.norm(F.col("term")).alias("term_n"), "term").where((F.length("term_n") >= 4) & ~F.trim("term").contains(" "))
    tokens = words.select("rec", "idx", "p_milli", t.norm(F.col("w")).alias("n")).where(F.length("n") >= 4)
    distinct = tokens.select("n").distinct().join(F.broadcast(terms), F.col("n") == F.col("term_n"), "left_anti")
    stems = distinct.select("n", F.explode(t.stems(F.col("n"))).alias("word")).join(dictionary, "word", "left_semi").select("n", F.lit(True).alias("known")).distinct()
    distinct = distinct.join(stems, "n", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # a variant's ratio is 8/11 or more, as words have four letters and endings three at most
    least = min(floor, known_floor, 8 / 11)
    sized = terms.withColumn("lt", letters(F.col("term_n"))).withColumn("size", F.explode(F.sequence(F.length("term_n") - 3, F.length("term_n") + 3)))
    tried = dealt(distinct, "n").withColumn("ln", letters(F.col("n"))).withColumn("size", F.length("n"))
    near = tried.join(F.broadcast(sized), "size").where(may_reach(F.col("n"), F.col("term_n"), F.col("ln"), F.col("lt"), least))
    near = near.withColumn("variant", t.variant_of(F.col("n"), F.col("term_n"))).withColumn("ratio", F.when(F.abs(F.length("n") - F.length("term_n")) <= 2, ratio_from(least)("n", "term_n")).otherwise(0.0))
    best = near.groupBy("n", "known").agg(F.max("variant").alias("variant"), F.max_by(F.struct("term", "ratio"), F.struct("ratio", -F.col("ord"))).alias("best")).where("NOT variant")
    hit = (F.col("best.ratio") >= F.when(F.col("known"), known_floor).otherwise(floor)) & (F.col("best.ratio") < ceiling)
    hits = best.where(hit).select("n", "known", "best.term", "best.ratio")
    return tokens.join(hits, "n").where(~F.col("known") | (F.col("p_milli") < gate)).select("rec", "idx", "term", "ratio")


def kept_words(words: DataFrame, *dropped: DataFrame) -> DataFrame:
    """Words whose (rec, idx) is in none of the given sets."""
    for gone in dropped:
        words = words.join(gone.select("rec", "idx"), ["rec", "idx"], "left_anti")
    return words


def ratios(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``ratio`` over distinct pairs of strings; a length bound of the ratio goes first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ratio=[difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(batch[a], batch[b], strict=True)])

    schema = pairs.select(a, b).withColumn("ratio", F.lit(0.0)).schema
    return pairs.join(pairs.select(a, b).distinct().mapInPandas(run, schema), [a, b])
