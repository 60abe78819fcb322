"""Quality rules: a decision list of threshold conjunctions learned by sequential covering, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, own_name, written
from .language_id import fold

#: What separates words, as a class of a regular expression.
SPACE = "[\\x20\\x09-\\x0D]"

SYMBOLS = "#*$%&|<>"

#: Words in a window that may be found again.
WINDOW = 3

#: Labelled rows that are learned from, about: those whose key has the smallest hash. They are broadcast to the documents.
TRAIN_ROWS = 40_000

#: Cut points of a statistic, rules of a list and conditions of a rule, at most.
CUTS, RULES, CONDITIONS = 32, 12, 4

#: Smoothed share of rejected rows among those that a rule covers in the pruning part, from which the rule is taken.
PURITY = 0.75

#: Statistics that conditions are about, as a count and what it is divided by; each is a number for every text.
STATISTICS = {
    "words": ("n_words", None),
    "word_size": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_word_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "bare_marks_per_word": ("n_bare_marks", "n_words"),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_exclaims", "n_bare_marks"]


class Condition(NamedTuple):
    """A statistic is ``cut`` or more, or less than it."""

    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.statistic) >= self.cut if self.above else F.col(self.statistic) < self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.cut:g}"


Rule = list[Condition]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over STATISTICS: the number of the first rule that covers a row, else null."""
    chain = None
    for i, rule in enumerate(rules):
        chain = F.when(covers(rule), F.lit(i)) if chain is None else chain.when(covers(rule), F.lit(i))
    return F.lit(None).cast("int") if chain is None else chain


def explain(rules: list[Rule]) -> str:
    return "\n".join([f"{i}: reject if {' and '.join(map(str, r))}" for i, r in enumerate(rules)] + ["else keep"])


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: the optimiser may put an expression where a column of it is named, also inside a function of an array's elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _together(rows: DataFrame, kept: str, **columns: Column) -> DataFrame:
    """``kept`` and the columns, as rows of a generator, which no filter or projection is moved across."""
    return rows.select(kept, F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("one")).select(kept, "one.*")


def _repeated(words: Column) -> Column:
    """How many words lie in windows that stand elsewhere in the text too.

    Windows are sorted by their hash with their places, so that equal ones are neighbours; the places that have
    an equal neighbour, in order, cover a window's words each, less what the next one covers.
    """
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]).alias("h"), i.alias("at"))))
    again = lambda all_: F.sort_array(F.transform(F.filter(all_, lambda w, j: (w["h"] == F.get(all_, j - 1)["h"]) | (w["h"] == F.get(all_, j + 1)["h"])), lambda w: w["at"]))
    covered = lambda at: F.aggregate(F.transform(at, lambda a, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - a, F.lit(WINDOW)))), F.lit(0), lambda n, x: n + x)
    return _once(_once(windows, again), covered)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS (long) behind its columns; a text that is null has none of anything.

    Words lie between characters of SPACE, lines between line feeds; a repeated line has a word and equals one before it.
    Windows of three words are told apart by 64 bits within a text. Names that ``docs`` bears already get underscores.
    """
    names = {c: own_name(docs, c) for c in COUNTS}
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # what is neither a small letter nor beyond ASCII is little
    rest = F.regexp_replace(body, "[a-z\\x{80}-\\x{10FFFF}]+", "")
    some = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.struct(body.alias("body"), rest.alias("rest")).alias("texts"))
    split = _together(
        some,
        "kept",
        words=F.array_remove(F.split("texts.body", f"{SPACE}+"), ""),
        lines=F.filter(F.split("texts.body", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        rest=F.col("texts.rest"),
        marks=F.regexp_replace("texts.rest", "[0-9A-Z\\x00-\\x20\\x7F]+", ""),
    )
    sizes = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": _without(F.col("marks"), SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated(F.col("words")),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_upper": _without(F.col("rest"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": _without(F.col("rest"), "0123456789"),
        "n_marks": F.length("marks"),
        "n_exclaims": _without(F.col("marks"), "!"),
        # a mark is bare where a space or another mark stands before it
        "n_bare_marks": F.regexp_count("rest", F.lit("(?<=[\\x00-\\x20!-/:-@\\[-`{-~])[!-/:-@\\[-`{-~]")),
    }
    found = _together(split, "kept", **{names[c]: sizes[c].cast("long") for c in COUNTS})
    return found.select("kept.*", *[f"`{names[c]}`" for c in COUNTS])


def with_statistics(counted: DataFrame) -> DataFrame:
    share = lambda top, bottom: F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(bottom, F.lit(1))
    return counted.select("*", *[share(*of).alias(name) for name, of in STATISTICS.items()])


def base_failed() -> Column:
    """Fewer than fifty words, or more than half of them in windows that are found again."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(bad, part, statistics) of about ``rows`` documents whose key is labelled, folds other than 2 only; every third is of the pruning part (1).

    A key's labels are averaged, null labels and keys left out. Documents that fail the base are no lesson.
    """
    marks = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull() & (fold(F.col(f"`{key}`")) != 2))
    marks = marks.groupBy(F.col(f"`{key}`").alias("its_key")).agg((F.avg(F.col(f"`{label}`").cast("double")) < 0.5).alias("bad")).withColumn("h", F.xxhash64(F.col("its_key").cast("string")))
    share = min(1.0, rows / max(1, marks.count()))
    few = marks.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(f"`{key}`").alias("the_key"), F.col(f"`{text}`").alias("the_text")).join(F.broadcast(few), F.col("the_key") == F.col("its_key"))
    learned = with_statistics(counts(texts.select("bad", (F.pmod(F.shiftright("h", 20), F.lit(3)) == 0).cast("int").alias("part"), "the_text"), "the_text")).where(~base_failed())
    return written(learned.select("bad", "part", *STATISTICS).coalesce(8), "labelled")


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each statistic, once each; at the lowest every row would be above."""
    found = rows.agg(*[F.percentile_approx(s, [i / CUTS for i in range(CUTS + 1)], 10_000).alias(s) for s in STATISTICS]).first()
    return {s: sorted(set(found[s] or []))[1:] for s in STATISTICS}


def _bin(statistic: str, at: list[float]) -> Column:
    """How many of the cuts a row reaches."""
    return F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c <= F.col(statistic))) if at else F.lit(0)


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> Condition | None:
    """The condition of the greatest information gain on rejected rows: their number times what it adds to the log of their share.

    One aggregate counts the rows of each statistic's bins; sums from both ends give every cut.
    """
    bins = F.array(*[F.struct(F.lit(i).alias("statistic"), F.col(f"bin_{s}").alias("bin")) for i, s in enumerate(cuts)])
    cells = rows.select("bad", F.explode(bins).alias("e")).groupBy("e.statistic", "e.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    best, found = 1e-9, None
    for i, (statistic, at) in enumerate(cuts.items()):
        bad, good = [0] * (len(at) + 1), [0] * (len(at) + 1)
        for c in cells:
            if c.statistic == i:
                bad[c.bin], good[c.bin] = c.bad, c.good
        all_bad, all_good = sum(bad), sum(good)
        if not all_bad:
            return None
        before, low_bad, low_good = math.log2(all_bad / (all_bad + all_good)), 0, 0
        for j, cut in enumerate(at):
            low_bad, low_good = low_bad + bad[j], low_good + good[j]
            for above, p, n in ((True, all_bad - low_bad, all_good - low_good), (False, low_bad, low_good)):
                gain = p * (math.log2(p / (p + n)) - before) if p else 0.0
                if gain > best:
                    best, found = gain, Condition(statistic, above, cut)
    return found


def learn(rows: DataFrame, purity: float = PURITY) -> list[Rule]:
    """A decision list from rows (bad, part, statistics): sequential covering of the bad ones.

    A rule grows on part 0 by the condition of the greatest gain until it covers no good row. On part 1 its last conditions
    are pruned while (bad - good) / (bad + good) does not fall. It is taken if its smoothed share of bad rows there is
    ``purity`` or more, and the rows that it covers are taken away; the first rule that is not ends the list. Each step
    is one aggregate over the bounded rows; what comes to the driver is a count for each bin. Ties go to the first statistic
    and the lowest cut. No bad rows, no rules.
    """
    cuts = _cuts(rows)
    binned = [_bin(s, at).alias(f"bin_{s}") for s, at in cuts.items()]
    left, rules = written(rows.select("*", *binned).coalesce(4), "binned"), []
    table = left
    while len(rules) < RULES:
        rule, grow = [], left.where("part = 0")
        while len(rule) < CONDITIONS:
            more = _best(grow, cuts)
            if more is None:
                break
            rule.append(more)
            grow = grow.where(more.column())
        if not rule:
            break
        sizes = [f(covers(rule[:k]) & b) for k in range(1, len(rule) + 1) for f in [F.count_if] for b in (F.col("bad"), ~F.col("bad"))]
        row = left.where("part = 1").agg(*sizes).first()
        worth = [(row[2 * k] - row[2 * k + 1]) / max(1, row[2 * k] + row[2 * k + 1]) for k in range(len(rule))]
        short = max(range(len(rule)), key=lambda k: (worth[k], -k))
        bad, good = row[2 * short], row[2 * short + 1]
        if (bad + 1) / (bad + good + 2) < purity:
            break
        rules.append(rule[: short + 1])
        left = left.where(~covers(rules[-1]))
    discard(table)
    return rules


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """(key, COUNTS, base_failed, rule, kept) of every document, and the list.

    ``rule`` is the number of the first rule of the learned list that covers the text, null if none does; a text is kept
    if it passes the base and no rule covers it. Null texts have no words, so the base fails them. Rows that repeat a key
    are judged one by one; a null key is judged but no lesson. Without labels nothing but the base rejects.
    """
    rows = labelled(docs, labels, key, text, label)
    rules = learn(rows)
    discard(rows)
    found = with_statistics(counts(docs.select(F.col(f"`{key}`").alias("the_key"), F.col(f"`{text}`").alias("the_text")), "the_text"))
    out = found.select(F.col("the_key").alias(key), *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
