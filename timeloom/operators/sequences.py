"""Alignment of many pairs of sequences at once: matching blocks by rounds of joins and windows, edit operations, ratios and swapped words."""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.functions import constants as C

from .stored import settled

#: Behind the end of any sequence.
_END = 1 << 30


def matching_blocks(pairs: DataFrame, key: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """``blocks_between`` the arrays ``a`` and ``b`` of each pair. Null arrays are empty, null elements match nothing."""
    side = lambda c, at: pairs.select(*key, F.posexplode(c).alias(at, "x"))
    return blocks_between(side(a, "i"), side(b, "j"), key)


BLOCKS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("i", "j", "size")]))


def _split(runs: list[tuple[int, int, int]], whole: bool, least: int) -> list[tuple[int, int, int]]:
    """Blocks that a longest-block matcher finds in the longest runs (-size, i, j) of a part, in that order.

    If they are not the ``whole`` of its runs, only blocks that come before the last one of them are sure.
    """
    last = None if whole else runs[-1]
    found: list[tuple[int, int, int]] = []  # (i, j, size), ascending
    while runs:
        run = heapq.heappop(runs)
        size, i, j = -run[0], run[1], run[2]
        if last is not None and run > last:
            break
        # the first block that does not end before the run on both sides, and that behind the last one that does not begin behind it
        low = bisect.bisect_left(found, True, key=lambda m: m[0] + m[2] > i or m[1] + m[2] > j)
        high = bisect.bisect_left(found, True, key=lambda m: m[0] >= i + size and m[1] >= j + size)
        if low >= high:
            found.insert(low, (i, j, size))
            continue
        # what is left of it in each gap between the blocks that it meets
        for n in range(low, high + 1):
            a0, b0 = (found[n - 1][0] + found[n - 1][2], found[n - 1][1] + found[n - 1][2]) if n else (0, 0)
            a1, b1 = found[n][:2] if n < len(found) else (_END, _END)
            late = max(0, a0 - i, b0 - j)
            left = min(size, a1 - i, b1 - j) - late
            if left >= least:
                heapq.heappush(runs, (-left, i + late, j + late))
    return found


@F.arrow_udf(BLOCKS)
def _blocks(runs: pa.Array, whole: pa.Array, least: pa.Array) -> pa.Array:
    flat, ends = runs.flatten(), np.append(0, np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))).tolist()
    size, i, j = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("size", "i", "j"))
    found, stops = [], [0]
    for a, b, every, shortest in zip(ends[:-1], ends[1:], whole.to_pylist(), least.to_pylist(), strict=True):
        if b - a == 1:
            found.append((i[a], j[a], size[a]))
        else:
            found += _split(sorted(zip((-size[a:b]).tolist(), i[a:b].tolist(), j[a:b].tolist(), strict=True)), every, shortest)
        stops.append(len(found))
    each = np.array(found, np.int32).reshape(-1, 3)
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays([pa.array(each[:, c]) for c in range(3)], ["i", "j", "size"]))


#: The longest runs of a part that one round looks at.
ROUND_RUNS = 500


def blocks_between(left: DataFrame, right: DataFrame, key: list[str], grams: tuple[int, ...] = (1,)) -> DataFrame:
    """(key, i, j, size): where stretches of two sequences, of elements (key, i, x) and (key, j, x) numbered from 0, are equal, as a longest-block matcher finds them.

    The longest stretch that both have (the first in ``left``, then in ``right``) splits a pair into what lies before it and what lies
    behind it, and so on. Runs are diagonals of equal elements; all pairs and parts are worked on together. A round splits every part by
    its longest runs, ROUND_RUNS at most, as far as no other can be longer; the next one looks for runs between what was found. Of long sequences that
    are much alike, runs of ``grams[0]`` elements or more are looked for first, as equal stretches of so many are far fewer than equal
    elements; shorter ones then, in what no longer one covers. The last number is 1.
    """
    side = lambda rows, at: rows.where("x IS NOT NULL").select(*key, F.lit(-1).alias("_gap"), F.col(at).cast("int").alias("_at"), "x")
    sides = {"i": side(left, "i"), "j": side(right, "j")}
    part = [*key, "_gap"]
    found = None
    for gram in grams:
        more = True
        while more:
            along = Window.partitionBy(*part).orderBy("_at")
            xs = [f"_x{n}" for n in range(gram)]
            # elements that follow without a hole
            near = lambda n: F.when(F.lead("_at", n).over(along) == F.col("_at") + n, F.lead("x", n).over(along))
            same = {}
            for at, rows in sides.items():
                beside = [near(-1).alias(f"_before_{at}"), near(gram).alias(f"_behind_{at}")]
                rows = rows.select(*part, F.col("_at").alias(at), F.col("x").alias("_x0"), *[near(n).alias(xs[n]) for n in range(1, gram)], *beside)
                same[at] = rows.where(F.col(xs[-1]).isNotNull())
            goes_on = lambda c: F.coalesce(F.col(f"{c}_i") == F.col(f"{c}_j"), F.lit(False))
            # only where equal stretches begin or end: the next end of a diagonal is that of the beginning before it
            dots = same["i"].join(same["j"], [*part, *xs]).select(*part, "i", (F.col("i") - F.col("j")).alias("_d"), goes_on("_before").alias("_from"), goes_on("_behind").alias("_on"))
            dots = dots.where("NOT (_from AND _on)")
            end = F.when(F.col("_on"), F.lead("i").over(Window.partitionBy(*part, "_d").orderBy("i"))).otherwise(F.col("i"))
            runs = dots.withColumn("_to", end).where("NOT _from").select(*part, "i", (F.col("i") - F.col("_d")).alias("j"), (F.col("_to") - F.col("i") + gram).alias("size"))
            nth = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("size"), "i", "j"))
            first = runs.withColumn("_nth", nth).where(F.col("_nth") <= ROUND_RUNS + 1)
            longest = F.collect_list(F.when(F.col("_nth") <= ROUND_RUNS, F.struct("size", "i", "j")))
            parts = first.groupBy(*part).agg(longest.alias("_runs"), (F.max("_nth") <= ROUND_RUNS).alias("_whole"))
            new = settled(parts.select(*part, "_whole", F.explode(_blocks("_runs", "_whole", F.lit(gram))).alias("_b")).select(*part, "_whole", "_b.*"))
            best = new.select(*key, "i", "j", "size")
            found = best if found is None else found.unionByName(best)
            more = not new.where("NOT _whole").isEmpty()
            if more or gram != grams[-1]:
                sides = {at: settled(_between(rows, new, part, at)) for at, rows in sides.items()}
    return found


def _between(rows: DataFrame, blocks: DataFrame, part: list[str], at: str) -> DataFrame:
    """Elements (part, _at, x) that no block covers, in the gaps between the blocks; a gap is known by where the block before it ends in ``i``."""
    none = F.lit(None).cast("int")
    ends = blocks.select(*part, F.col(at).alias("_at"), none.alias("_n"), (F.col(at) + F.col("size")).alias("_to"), (F.col("i") + F.col("size")).alias("_end"))
    both = rows.withColumns({"_n": F.lit(1), "_to": none, "_end": none}).unionByName(ends, allowMissingColumns=True)
    # at the same place the block comes first
    before = Window.partitionBy(*part).orderBy("_at", F.asc_nulls_first("_n"))
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    held = both.select(*part, "_at", "x", "_n", last("_to").alias("_to"), last("_end").alias("_end")).where("_n = 1 AND (_to IS NULL OR _at >= _to)")
    return held.select(*[c for c in part if c != "_gap"], F.coalesce("_end", "_gap").alias("_gap"), "_at", "x")


def ratios(pairs: DataFrame, key: list[str], a: str = "a", b: str = "b", blocks: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``matched``, the elements in matching blocks, and ``ratio``: twice that for the length of both; 1 if both are empty."""
    blocks = matching_blocks(pairs, key, a, b) if blocks is None else blocks
    total = F.size(F.coalesce(a, F.array())) + F.size(F.coalesce(b, F.array()))
    rows = pairs.join(blocks.groupBy(*key).agg(F.sum("size").alias("matched")), key, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return rows.withColumn("ratio", F.when(total == 0, 1.0).otherwise(2 * F.col("matched") / total))


def edit_operations(pairs: DataFrame, key: list[str], blocks: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(key, op, i0, i1, j0, j1): what lies between the blocks, as replace, delete or insert of a[i0:i1] and b[j0:j1]."""
    size = lambda c: F.size(F.coalesce(c, F.array()))
    ends = blocks.select(*key, "i", "j", "size").unionByName(pairs.select(*key, size(a).alias("i"), size(b).alias("j"), F.lit(0).alias("size")))
    order = Window.partitionBy(*key).orderBy("i", "j", "size")
    since = lambda c: F.coalesce(F.lag(F.col(c) + F.col("size")).over(order), F.lit(0))
    gaps = ends.select(*key, since("i").alias("i0"), F.col("i").alias("i1"), since("j").alias("j0"), F.col("j").alias("j1"))
    gone, come = F.col("i1") > F.col("i0"), F.col("j1") > F.col("j0")
    op = F.when(gone & come, "replace").when(gone, "delete").otherwise("insert")
    return gaps.where(gone | come).select(*key, op.alias("op"), "i0", "i1", "j0", "j1")


def swapped_words(pairs: DataFrame, key: list[str], operations: DataFrame, heard: str, a: str = "a", b: str = "b", least: float = 0.7) -> DataFrame:
    """(key, old, new): the first word of ``b`` that stands for a different one of ``a`` or was put in.

    Of a replacement the n-th new word stands for the n-th old one, and is a different one if their letters' ratio is below ``least`` or
    there is none; a word that is put in counts from four letters. Small words and those of ``heard`` never count. Words are lower case.
    """
    rows = operations.where("op <> 'delete'").join(pairs.select(*key, a, b, heard), key)
    each = rows.select(*key, "op", "i0", "j0", F.explode(F.sequence(F.col("j0"), F.col("j1") - 1)).alias("at"), "i1", a, b, heard)
    old = F.when((F.col("op") == "replace") & (F.col("i0") + F.col("at") - F.col("j0") < F.col("i1")), F.get(a, F.col("i0") + F.col("at") - F.col("j0")))
    each = each.select(*key, "op", "at", old.alias("old"), F.get(b, F.col("at")).alias("new"), heard)
    each = settled(each.where(~F.col("new").isin(C.SCRIPT_STOP_WORDS) & ~F.array_contains(heard, F.col("new"))).drop(heard))
    letters = lambda c: F.array_remove(F.split(c, ""), "")
    words = each.where("old IS NOT NULL").select("old", "new").distinct().withColumns({"_a": letters("old"), "_b": letters("new")})
    alike = ratios(words, ["old", "new"], "_a", "_b").where(F.col("ratio") >= least).select("old", "new", F.lit(True).alias("alike"))
    told = each.join(alike, ["old", "new"], "left").where(F.when(F.col("op") == "insert", F.length("new") > 3).otherwise(F.col("alike").isNull()))
    return told.groupBy(*key).agg(F.min(F.struct("at", "old", "new")).alias("_s")).select(*key, F.coalesce("_s.old", F.lit("")).alias("old"), F.col("_s.new").alias("new"))


def number_said(number: Column, spoken: Column) -> Column:
    """Whether digits stand in what was spoken, as they are or as a word."""
    word = F.coalesce(F.create_map(*[F.lit(x) for pair in C.NUMBER_WORDS.items() for x in pair])[number.try_cast("int")], F.lit("#"))
    return spoken.contains(number) | spoken.contains(word)


def near_names(words: DataFrame, names: list[str], least: float = 0.8, shortest: int = 5) -> DataFrame:
    """(word, name) of different words (word) and the names they look like: other letters, the same first one, and a ratio of ``least`` or more.

    Words that are a name in another case are no near miss; words below ``shortest`` letters are left out. Only words whose letters could
    reach the ratio at all are aligned: what two words share is at most the shorter, and at most the letters they have in common.
    """
    given = words.sparkSession.createDataFrame([(n, n.lower()) for n in dict.fromkeys(names)], "name string, _b string")
    each = words.select("word", F.lower("word").alias("_a")).distinct().where(F.length("_a") >= shortest)
    met = each.join(F.broadcast(given), (F.substring("_a", 1, 1) == F.substring("_b", 1, 1)) & (F.col("_a") != F.col("_b")))
    letters = lambda c: F.array_remove(F.split(c, ""), "")
    both = F.length("_a") + F.length("_b")
    # letters of one that the other has, counted as often as they stand there, are at least those that match
    held = F.least(F.size(F.filter(letters("_a"), lambda x: F.contains(F.col("_b"), x))), F.size(F.filter(letters("_b"), lambda x: F.contains(F.col("_a"), x))))
    able = settled(met.where(2 * held >= least * both).select("word", "name", letters("_a").alias("_x"), letters("_b").alias("_y")))
    return ratios(able, ["word", "name"], "_x", "_y").where(F.col("ratio") >= least).select("word", "name")
