"""Counts of texts against brute force; the learned list on statistics with a known rule; empty, null, long and repeated rows."""

import random
import re

from pyspark.sql import functions as F

from timeloom.llm import quality_rules as Q

SPACED = r"[^\x20\x09-\x0D]"


def brute(text):
    text = text or ""
    w = re.findall(SPACED + "+", text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACED, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a b", "a a a a", "a b c a b c a", "x\n\nx\nx \nx", "     é", "## | <b>\u0001 9", "ABC! d!! e.", "w " * 30_000]
    texts += [" ".join(rng.choice(["aa", "b", "Çé", "#", "d\n", "e\r\nf"]) for _ in range(rng.randrange(90))) for _ in range(120)]
    docs = table(spark, [(i, t, 7, i) for i, t in enumerate(texts)], "n_words int, text string, n_lines int, i int")
    counted = Q.counts(docs)
    assert counted.columns[:4] == docs.columns and {"n_words_", "n_lines_"} <= set(counted.columns)
    found = {r.i: (r.n_words_, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in counted.collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_list_learns_the_rule_of_its_labels(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        values = [round(rng.random(), 3) for _ in Q.STATISTICS]
        by = dict(zip(Q.STATISTICS, values, strict=True))
        bad = by["upper_share"] >= 0.8 or (by["symbols_per_word"] >= 0.6 and by["word_size"] < 0.3)
        rows.append((bad != (rng.random() < 0.01), rng.randrange(3) // 2, *values))
    data = table(spark, rows, "bad boolean, part int, " + ", ".join(f"{s} double" for s in Q.STATISTICS))
    rules = Q.learn(data)
    hit = data.withColumn("rejected", Q.verdict(rules).isNotNull()).groupBy("bad").agg(F.avg(F.col("rejected").cast("double")).alias("share"))
    share = {r.bad: r.share for r in hit.collect()}
    assert share[True] > 0.85 and share[False] < 0.05
    assert all(len(r) <= Q.CONDITIONS for r in rules) and Q.explain(rules).endswith("else keep")
    assert Q.learn(data.where("NOT bad")) == [] and Q.learn(data.limit(0)) == []


def test_list_of_noise_rejects_nothing(spark):
    rng = random.Random(6)
    rows = [(rng.random() < 0.2, rng.randrange(3) // 2, *[rng.random() for _ in Q.STATISTICS]) for _ in range(1500)]
    assert Q.learn(table(spark, rows, "bad boolean, part int, " + ", ".join(f"{s} double" for s in Q.STATISTICS))) == []


def test_judge(spark):
    rng = random.Random(7)
    clean = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    junk = lambda: " ".join(f"w{rng.randrange(10**6)}#%" for _ in range(80))
    texts = [junk() if i % 4 == 0 else clean() for i in range(800)]
    docs = table(spark, [(i, t, "x") for i, t in enumerate(texts)] + [(None, clean(), "x"), (5, None, "x"), (5, "short", "x"), (5, clean(), "x")], "doc_id long, text string, kept string")
    labels = table(spark, [(i, int(i % 4 > 0), 9) for i in range(800)] + [(None, 0, 9), (3, None, 9), (1, 1, 9)], "doc_id long, quality int, bad int")
    out, rules = Q.judge(docs, labels)
    rows = out.collect()
    assert len(rows) == 804 and rules
    assert all(r.kept == (r.doc_id is None or r.doc_id % 4 > 0) for r in rows if not r.base_failed)
    assert sum(r.base_failed for r in rows) == 2 and not any(r.kept for r in rows if r.base_failed)
    out, rules = Q.judge(docs.limit(0), labels.limit(0))
    assert out.collect() == [] and rules == []
