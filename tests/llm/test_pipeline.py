"""The stages of the corpus pipeline against brute force: nulls, empty and long texts, repeated rows and keys, clashing columns, empty tables."""

import random

import pytest
from test_operators import groups, words

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from timeloom.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lines int, removed int, spans string, score int"


def table(spark, rows):
    """(doc_id, text) or (doc_id, text, lang) rows with further columns, whose names the stages use too."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None, i, -i, "z", 7) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def stage(spark, name, docs, sf_dir=""):
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    if name != "best_fit_packing":
        assert got.columns == docs.columns
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.where("false"), sf_dir).count() == 0
    return sorted(got.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, getattr(r, "text", "") or ""))


def test_language_stage(spark):
    rng = random.Random(1)
    say = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(12))
    rows = [(i, say(["ko", "ra", "mi"]) if i % 2 else say(["schn", "brt", "zw"]), "aa" if i % 2 else "bb") for i in range(80)]
    rows += [(100, None, "aa"), (101, "", "aa"), (102, "12 ... 3", "bb"), (103, rows[1][1], None), (104, rows[0][1] * 300, None), (None, rows[1][1], None), (5, rows[5][1], "aa")]
    got = stage(spark, "language_id", table(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows if r[0] not in (100, 101, 102))
    assert {r.doc_id: r.lang for r in got} == {r[0]: r[2] or {103: "aa", 104: "bb", None: "aa"}[r[0]] for r in rows if r[0] not in (100, 101, 102)}
    assert all(r.spans == "z" and r.score == 7 for r in got)


def test_line_stage(spark):
    """Exact repetitions, as no line here is near another: the first by key and line stays."""
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["ab", "cd ef", "gh ij kl", "--", "", "mn\tOP", "mn op!", "1 2", "3 4"]) for _ in range(rng.randrange(6)))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "x " * 9000 + "\nab"), (None, "cd ef")]
    seen, want = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        stay = []
        for line in (text or "").split("\n"):
            norm = tuple("".join("0" if c.isdigit() else c for c in w) for w in words(line))
            if not norm or norm not in seen:
                stay.append(line)
            seen.add(norm)
        if words("\n".join(stay)):
            want.append((key, "\n".join(stay)))
    got = stage(spark, "line_dedup", table(spark, rows))
    assert [(r.doc_id, r.text) for r in got] == want and all(r.n_chars == len(r.text) and r.spans == "z" for r in got)


def test_document_stage(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = [*rng.choice(base)]
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(7, "quite another text that repeats an id"), (None, rows[0][1]), (None, "a null id"), (None, "a null id"), (80, None), (80, None), (81, ""), (82, "long " * 8000), (83, "long " * 8000), rows[4]]
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = groups(range(len(rows)), links)
    got = stage(spark, "ngram_jaccard_join", table(spark, rows))
    for group in set(of.values()):
        mine = [rows[i] for i in of if of[i] == group]
        kept = [r for r in got if any((r.doc_id, r.text) == m for m in mine)]
        assert len(kept) == (1 if sets[group] else len([r for r in rows if (r[0], r[1]) in mine]))
        assert (kept[0].doc_id is None) == any(m[0] is None for m in mine) and kept[0].doc_id in (None, min((m[0] for m in mine if m[0] is not None), default=None))


def test_decontamination_stage(spark, tmp_path):
    rng = random.Random(4)
    items = [" ".join(f"q{rng.randrange(20)}" for _ in range(n)) for n in (3, 12, 15)] + ["", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, " ".join([f"c{i}", *rng.choice([items[0], items[1], "", items[2][:-1]]).split(), "end", *rng.choice([items[2], "q1 q2"]).split()])) for i in range(20)]
    rows += [(50, items[1]), (51, None), (52, ""), (53, "c " * 9000 + items[0]), (None, items[0] + " stays"), (3, rows[3][1])]
    want = []
    for key, text in rows:
        w, hit = words(text), set()
        for item in items:
            p = words(item)
            for n in [min(10, len(p))] if p else []:
                for at in range(len(p) - n + 1):
                    hit |= {j for i in range(len(w)) if w[i : i + n] == p[at : at + n] for j in range(i, i + n)}
        left = [x for j, x in enumerate(w) if j not in hit]
        if left:
            want.append((key is not None, key or 0, left))
    got = stage(spark, "benchmark_decontamination", table(spark, rows), str(tmp_path))
    assert sorted((r.doc_id is not None, r.doc_id or 0, words(r.text)) for r in got) == sorted(want) and all(r.spans == "z" for r in got)


def test_packing_stage_and_run(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(rng.choice([5, 200, 1500]))), "en") for i in range(12)] + [(20, None, None), (None, word(), None), (3, word(), "en")]
    got = stage(spark, "best_fit_packing", table(spark, rows))
    assert {r.doc_id for r in got} == {r[0] for r in rows} and all(0 < r.length <= 2048 and 0 <= r.offset <= 2048 - r.length for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for mine in places.values():
        at = 0
        for offset, length in sorted(mine):
            assert offset == at
            at += length
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this stands there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in done} == {r[0] for r in rows if r[1]} and language_id.SWITCH > 0


def test_batches_stay_small(spark):
    """A table that a stage writes on its way gets the stage's Arrow batches, not larger ones."""
    import pyarrow as pa
    from timeloom.llm.common import written

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [batch.nbytes]})

    def largest(df):
        return written(df.mapInArrow(sizes, "id long"), "sizes").agg({"id": "max"}).first()[0]

    try:
        long = spark.range(0, 80, 1, 1).selectExpr("id", "repeat(string(id % 10), 100000) as text")
        spark.conf.set(name, "64MB")
        assert 3_000_000 < largest(long) < 5_000_000
        assert spark.conf.get(name) == "64MB"
        corpus_pipeline._small_batches(lambda *_: None)(spark, long, "")
        assert 500_000 < largest(long) < 1_300_000
        assert spark.conf.get(name) == corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_packing_remembers_little():
    """What a worker keeps of the words it met stays within the pipeline's bounds and a chunk's words; the ids do not depend on it."""
    import public_tokenizers
    from timeloom.llm import packing

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    assert corpus_pipeline.PACKED["words"] <= 100_000 and corpus_pipeline.PACKED["parts"] <= 150_000
    words = ["".join(rng.choice("abcdeé19") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ",", "'s", "-X"]) for _ in range(3_000)]
    chunks = [[" ".join(rng.choices(words, k=150)).encode() for _ in range(4)] for _ in range(12)]
    packing._LOADED.clear()
    want = [packing._ids_of(path, texts) for texts in chunks]
    assert len(packing._LOADED[path][1]) > 1_500
    packing._LOADED.clear()
    for texts, ids in zip(chunks, want, strict=True):
        assert packing._ids_of(path, texts, 200, 300) == ids
        assert len(packing._LOADED[path][1]) <= 200 + 600 and len(packing._LOADED[path][2]) <= 300 + 1_200
    packing._LOADED.clear()
