"""Alignment and the judge of replies against a plain matcher, pair by pair."""

import difflib
import random

from pyspark.sql import functions as F

from timeloom.functions import constants as C
from timeloom.operators import align, rules
from timeloom.operators import sequences as seq


def matcher(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False)


def some_pairs(rng, n=120):
    out = [([], []), ([], ["a"]), (["a"], []), (["a", "a", "a"], ["a", "a"]), (["a"] * 40, ["a", "b"] * 20)]
    for _ in range(n):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcxyz"))
        out.append((a, b if rng.random() < 0.8 else [rng.choice("abcdef") for _ in range(rng.randrange(14))]))
    return out


def test_blocks_ratios_and_operations(spark):
    pairs = some_pairs(random.Random(2))
    df = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(pairs)], "id int, a array<string>, b array<string>, size string")
    blocks = seq.settled(seq.matching_blocks(df, ["id"]))
    found, joined = {}, {}
    for r in blocks.collect():
        found.setdefault(r.id, []).append((r.i, r.j, r.size))
    for i, (a, b) in enumerate(pairs):
        # neighbours that touch are one block there
        parts = []
        for x, y, n in sorted(found.get(i, [])):
            if parts and (parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]) == (x, y):
                x, y, n = parts[-1][0], parts[-1][1], parts.pop()[2] + n
            parts.append((x, y, n))
        joined[i] = parts
        assert parts == [tuple(m) for m in matcher(a, b).get_matching_blocks() if m.size], (a, b)
    ratio = {r.id: r.ratio for r in seq.ratios(df, ["id"], blocks=blocks).collect()}
    assert all(abs(ratio[i] - matcher(a, b).ratio()) < 1e-12 for i, (a, b) in enumerate(pairs))
    ops = {(r.id, r.op, r.i0, r.i1, r.j0, r.j1) for r in seq.edit_operations(df, ["id"], blocks).collect()}
    assert ops == {(i, *o) for i, (a, b) in enumerate(pairs) for o in matcher(a, b).get_opcodes() if o[0] != "equal"}


def test_blocks_are_found_in_few_rounds_whatever_lies_within_what(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(seq, "settled", lambda rows, settled=seq.settled: calls.append(1) or settled(rows))
    rng = random.Random(5)
    # stretches of falling length, each behind a word that the other side lacks: a split within a split, thirty deep
    deep = [[f"w{n}-{k}" for k in range(40 - n)] for n in range(30)]
    pairs = {0: (sum(deep, []), sum([d + ["?"] for d in deep], []))}
    for n in range(1, 12):
        a = [rng.choice("abc") for _ in range(rng.randrange(60))]
        pairs[n] = (a, [x if rng.random() < 0.85 else rng.choice("abcx") for x in a if rng.random() < 0.9])
    side = lambda at: [(n, i, x) for n, pair in pairs.items() for i, x in enumerate(pair[at])]
    left, right = (spark.createDataFrame(side(at), f"id int, {c} int, x string") for at, c in ((0, "i"), (1, "j")))

    def blocks(grams):
        rows = seq.blocks_between(left, right, ["id"], grams).collect()
        return {n: sorted((r.i + k, r.j + k) for r in rows if r.id == n for k in range(r.size)) for n in pairs}

    want = {n: [(m.a + k, m.b + k) for m in matcher(*pair).get_matching_blocks() for k in range(m.size)] for n, pair in pairs.items()}
    assert blocks((4, 1)) == want and len(calls) <= 4
    monkeypatch.setattr(seq, "ROUND_RUNS", 12)
    assert blocks((3, 1)) == want


def swapped(a, b, heard):
    for op, i0, i1, j0, j1 in matcher(a, b).get_opcodes():
        for k, new in enumerate(b[j0:j1]):
            if new in C.SCRIPT_STOP_WORDS or new in heard:
                continue
            old = a[i0 + k] if op == "replace" and i0 + k < i1 else None
            if op == "replace" and (old is None or matcher(old, new).ratio() < 0.7):
                return old or "", new
            if op == "insert" and len(new) > 3:
                return "", new
    return None


def test_swapped_words(spark):
    rng = random.Random(5)
    vocabulary = ["workers", "worker", "authors", "share", "shared", "the", "of", "button", "bottom", "it", "open", "word", "file", "a"]
    rows = []
    for i in range(150):
        a = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))]
        b = [rng.choice(vocabulary) if rng.random() < 0.2 else x for x in a if rng.random() < 0.9]
        if rng.random() < 0.3:
            b.insert(rng.randrange(len(b) + 1), rng.choice(vocabulary))
        rows.append((i, a, b, [rng.choice(vocabulary)]))
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>, heard array<string>")
    blocks = seq.settled(seq.matching_blocks(df, ["id"]))
    found = {r.id: (r.old, r.new) for r in seq.swapped_words(df, ["id"], seq.edit_operations(df, ["id"], blocks), "heard").collect()}
    assert found == {i: s for i, a, b, h in rows if (s := swapped(a, b, h))}


def test_verdicts(spark):
    line = "We share the file with co-workers here"
    cases = [
        (line, "said", None, True, None, None, None),
        (line, "said", "DROP.", True, None, None, None),
        (line, "said", " drop ", False, "drop", None, None),
        (line, "said", line + " ", True, None, None, None),
        (line, "said", "we share it", False, "rejected", "lowercase", None),
        (line, "said", "We share it, then;", False, "rejected", "mid-sentence", None),
        (line, "one series", "We share M1 and 07.", False, "rejected", "number", "07"),
        (line, "said", "We share the file with co-authors here", True, "rejected", "swapped", "workers>authors"),
        (line, "said authors", "We share the file with co-authors here", True, "spruce", None, None),
        (line, "said", "We share the files with co-workers here", True, "spruce", None, None),
        (line, "said", "Nothing of it remains", True, "rejected", "rewritten", "0"),
        (line, "said", "We share the file with co-workers here and then we go on", True, "rejected", "rewritten", "761"),
        (line, "said", "Share it here with everyone we know of now", False, "rejected", "long", None),
        (line, "said", "Shared", False, "rejected", "short", None),
        (line, "said", "Share the file.", False, "polish", None, None),
        (None, None, "New words", False, "polish", None, None),
        ("", "", "", True, None, None, None),
    ]
    rows = [(i, now, said, got, edited, 5, 8) for i, (now, said, got, edited, *_) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, now string, said string, got string, edited boolean, cap int, budget int")
    found = {r.id: (r.kind, r.why, r.detail) for r in rules.judged(df, ["id"]).collect()}
    assert found == {i: c[4:] for i, c in enumerate(cases)}
    assert rules.judged(df.where("false"), ["id"]).count() == 0


def test_words_that_want_a_plural(spark):
    df = spark.createDataFrame([("It is one of the here things.",), ("It is one of the which",), ("It is one of the file.",)], "text string")
    notes = [r.n for r in df.select(rules.notes(F.col("text")).alias("n")).collect()]
    assert ["singular" in n for n in notes] == [False, False, True]


def test_units_are_found_in_the_words_heard(spark):
    rng = random.Random(12)
    vocabulary = ["we", "see", "it's", "the", "file", "open", "page", "-", "a", "list"]
    units, words, want = [], [], set()
    for rec in range(6):
        script, heard = [], []
        for unit in range(5):
            text = [rng.choice(vocabulary) for _ in range(rng.randrange(9))]
            units.append((rec, unit, " ".join(text) if unit != 3 else None))
            script += [(unit, w) for w in text if unit != 3]
            heard += [w for w in text if rng.random() < 0.8] + [rng.choice(vocabulary) for _ in range(rng.randrange(3))]
        words += [(rec, i, w.upper(), 100 * i, 100 * i + 50) for i, w in enumerate(heard)]
        key = lambda w: "".join(c for c in w.lower() if c.isalnum())
        script = [(u, key(w)) for u, w in script if key(w)]
        heard = [key(w) for w in heard]
        met = {}
        for m in matcher([k for _, k in script], heard).get_matching_blocks():
            for n in range(m.size):
                met.setdefault(script[m.a + n][0], []).append(m.b + n)
        want |= {(rec, u, 100 * min(at), 100 * max(at) + 50, len(at)) for u, at in met.items()}
    found = align.align_units(spark.createDataFrame(units, "rec long, unit long, text string"), spark.createDataFrame(words, "rec long, idx long, w string, start_ms long, end_ms long"))
    assert {tuple(r) for r in found.select("rec", "unit", "start_ms", "end_ms", "matched").collect()} == want and want
