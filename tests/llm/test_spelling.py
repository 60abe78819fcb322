"""Spelling variants against all pairs: short and long words, runs of one letter, ties, chains of forms, empty and null rows."""

import random
import re
import zlib

from timeloom.llm import spelling
from timeloom.llm.queries import op13_spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_pairs(counts, times=10):
    out = {}
    for w, n in counts.items():
        near = sorted(((-m, v) for v, m in counts.items() if v != w and one_edit(v, w)), key=lambda x: (x[0], x[1].encode()))
        out[w] = (near[0][1] if near and -near[0][0] >= times * n else None, n, len(near), -near[0][0] if near and -near[0][0] >= times * n else None)
    rows = set()
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, near, form_n))
    return rows


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_all_pairs(spark):
    rng = random.Random(5)
    counts = {}
    for base in ["abababab", "aaaaaaaa", "straße", "k" * 39, "xy" * 20, "z" * 41, "q" * 3000]:
        words = {base}
        for _ in range(12):
            w = rng.choice(sorted(words))
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abßÿ") + w[i:], w[:i] + rng.choice("abßÿ") + w[i + 1 :]]))
        counts |= {w: rng.choice([2, 3, 30, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, root int").repartition(3)
    assert rows(spelling.variants(df)) == by_pairs(counts)


def test_forms_chain_and_ties(spark):
    counts = {"abcdefg": 5, "abcdefh": 50, "abcdeih": 500, "abcjeih": 50_000, "abcdefi": 50, "lonelyword": 9}
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert (found["abcdefg"].form, found["abcdefg"].root) == ("abcdefh", "abcjeih")
    assert (found["lonelyword"].form, found["lonelyword"].root, found["lonelyword"].n_near) == (None, "lonelyword", 0)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_query_equals_the_texts_words(spark, tmp_path):
    rng = random.Random(8)
    words = ["Variant", "variant", "variants", "varlant", "ÀÉßÿÀÉß", "shortw", "x×÷yabcde", "multiplication"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "s", "1"]) for _ in range(60)) for _ in range(80)] + [None, "", "...", "m" * 5000, "m" * 5000]
    docs = [(i if i else None, t, "w", 1) for i, t in enumerate(texts)] + [(3, texts[3], "w", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, word string, n int").write.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for doc, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] = counts.get(w, 0) + 1
    assert rows(op13_spelling(spark, str(tmp_path))) == by_pairs({w: n for w, n in counts.items() if n >= 2})


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([("a", "Hello wonderful worldly", 1)], "word string, text string, n int")
    assert [tuple(r) for r in spelling.runs(docs).select("word", "n", "word_").collect()] == [("a", 1, "wonderful"), ("a", 1, "worldly")]
