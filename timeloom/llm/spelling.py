"""Spelling variants: permuterm rotations of words, grouped by the prefix that skips the edited character."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT, ascii_lower, discard, fields, own_name, written

#: Characters of a word: ASCII letters and the block of Latin letters behind them.
LETTERS = "A-Za-z\\u00C0-\\u00FF"

#: Marks the end of a word within a rotation; no letter.
END = "$"

#: Code points of a rotation that is kept as text; a longer one stands as two hashes, so that a word's rotations take room in proportion to it.
TEXT_SIZE = 40

#: Modulus and base of those hashes.
_PRIME, _BASE = (1 << 89) - 1, 0x1D3A5F1B27C94E8D3B


def runs(docs: DataFrame, text: str = "text", least_size: int = 7) -> DataFrame:
    """``docs`` with one row for each maximal run of LETTERS of at least ``least_size``, A-Z lower-cased, as ``word`` instead of the text.

    Null texts have none. The name has underscores behind it where another column bears it.
    """
    rest = docs.drop(text)
    word = own_name(rest, "word")
    found = docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least_size},}}"), F.lit(0))).alias(word))
    return found.withColumn(word, F.when(F.col(word).rlike("[A-Z]"), ascii_lower(F.col(word))).otherwise(F.col(word)))


def counted(words: DataFrame, word: str = "word", least_size: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of the different words of at least ``least_size`` code points that stand ``least_count`` times or more; null is no word."""
    kept = words.select(F.col(f"`{word}`").alias("word")).where(F.length("word") >= least_size)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """Of (word, n): (key, skipped, n) of rotations of the word with END behind it, TEXT_SIZE code points of key at most.

    A rotation that ends with a letter gives a key without that letter, and the letter as ``skipped``; a whole
    rotation is a key with nothing skipped. Words x·a·y and x·b·y have the key y$x in common, x·y has it whole.
    The word can be read off key and letter.
    """
    word, size = F.col("word"), F.length("word")

    def turned(first: Column | int, i: Column) -> Column:
        return F.concat(F.substr(word, i + first), F.lit(END), F.substr(word, F.lit(1), i))

    skips = F.when(size <= TEXT_SIZE, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(turned(2, i).alias("key"), F.substr(word, i + 1, F.lit(1)).alias("skipped"))))
    wholes = F.when(size < TEXT_SIZE, F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(1, i).alias("key"), F.lit("").alias("skipped"))))
    both = F.concat(F.coalesce(skips, F.array()), F.coalesce(wholes, F.array()))
    return words.select("n", F.explode(both).alias("e")).select("e.key", "e.skipped", "n")


def _near(letter: str, m: Column, o: Column, ends_with: Column) -> Column:
    """Whether two entries of a key are neighbours: both skip another letter, or one is whole and the other's letter is the first of its run.

    Any letter of a run can go to the same effect; only the first counts.
    """
    one_whole = (m[letter] == "") | (o[letter] == "")
    return (m[letter] != o[letter]) & (~one_whole | (F.concat(m[letter], o[letter]) != ends_with))


def near_words(words: DataFrame) -> DataFrame:
    """Of (word, n): (word, n_near, best) with the number of words one edit away and the commonest of them (less, word), for words that have any.

    Rotations are sorted by key; what shares one is at most the letters of the alphabet and one whole word, and
    every pair meets in one key. A key's entries give each of its words a number and a best neighbour, not pairs.
    """
    key = F.col("key")
    tail, head = F.substring_index(key, END, 1), F.substring_index(key, END, -1)
    grouped = rotations(words).groupBy("key").agg(F.collect_list(F.struct("skipped", "n")).alias("entries")).where(F.size("entries") > 1)
    parts = grouped.select("entries", tail.alias("tail"), head.alias("head"), F.right("key", F.lit(1)).alias("before"))
    told = lambda e: F.concat(F.col("head"), e["skipped"], F.col("tail"))

    def summary(m: Column) -> Column:
        near = F.filter("entries", lambda o: _near("skipped", m, o, F.col("before")))
        return F.struct(told(m).alias("word"), F.size(near).cast("long").alias("n_near"), F.array_min(F.transform(near, lambda o: F.struct((-o["n"]).alias("less"), told(o).alias("word")))).alias("best"))

    found = parts.select(F.explode(F.transform("entries", summary)).alias("s")).select("s.*").where("n_near > 0")
    return found.unionByName(_near_long(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _long_rotations(words: DataFrame) -> DataFrame:
    """Of (id, word): (key, id, skipped) of the rotations too long to stand as text."""
    schema = T.StructType(fields(key=TEXT, id=TEXT, skipped=TEXT, before=TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                size = len(word)
                heads, tails, power = [0], [0], 1
                for c in word:
                    heads.append((heads[-1] * _BASE + ord(c) + 1) % _PRIME)
                for c in reversed(word):
                    tails.append((tails[-1] + (ord(c) + 1) * power) % _PRIME)
                    power = power * _BASE % _PRIME
                tails.reverse()
                keys = [f"{heads[i]:x} {tails[i]:x}" for i in range(size + 1)]
                letters, before = [""] * (size + 1), [END, *word]
                if size > TEXT_SIZE:
                    keys += [f"{heads[i]:x} {tails[i + 1]:x}" for i in range(size)]
                    letters, before = letters + list(word), before + [END, *word[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([name] * len(keys)), pa.array(letters), pa.array(before)], names=schema.names)

    return words.mapInArrow(run, schema)


def _near_long(words: DataFrame) -> DataFrame:
    """``near_words`` for pairs of which one word has more than TEXT_SIZE code points or both have as many; their entries bear a name for the word."""
    long = words.where(F.length("word") >= TEXT_SIZE).withColumn("id", F.md5("word"))
    grouped = _long_rotations(long.select("id", "word")).groupBy("key", "before").agg(F.collect_set(F.struct("id", "skipped")).alias("entries")).where(F.size("entries") > 1)
    each = grouped.select("entries", "before", F.explode("entries").alias("m"))
    pairs = each.select(F.col("m.id").alias("id"), F.explode(F.filter("entries", lambda o: _near("skipped", F.col("m"), o, F.col("before")))["id"]).alias("other"))
    other = long.select(F.col("id").alias("other"), F.struct((-F.col("n")).alias("less"), "word").alias("best"))
    return pairs.join(other, "other").join(long.select("id", "word"), "id").select("word", F.lit(1).cast("long").alias("n_near"), "best")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Of the distinct (word, n): word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes them equal. ``form`` is the near word
    of the largest n, of several the first in code-point order, if that n is ``times`` the word's or more, else
    null; ``root`` is where the forms end. n grows by that factor from form to form, so pointers are doubled a few
    times only. An empty table has no rows. Further columns are left out; words must be without END.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words)
    form = F.col("best.less") <= -times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n"))
    found = written(found, "forms")
    discard(words)
    roots = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = written(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = joined.where("moved").limit(1).count()
        discard(roots)
        roots = joined
        if not moved:
            break
    return found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
