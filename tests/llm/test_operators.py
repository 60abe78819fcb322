"""The ten operators against brute force on small fixtures with nulls, empty and repeated rows, ties and clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import common, components, decontamination, embedding_dedup, fm_index, jaccard, language_id, license_scan, line_dedup, packing, quality, url_filter, warc
from timeloom.llm.queries import RULES, op4_line_dedup

DOCS = "doc_id long, text string, spans int, sig int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def random_texts(rng, n, vocabulary=30, most=60):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = f"x{rng.randrange(vocabulary)}"
        else:
            w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(most))]
        out.append(" ".join(w))
    return out


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        text = rng.integers(0, 4, n)
        text[-1] = 0
        index = fm_index.FMIndex(text, 4)
        for length in (1, 2, 3):
            patterns = rng.integers(1, 5, (5, length))
            for p, a, b in zip(patterns, *index.find(patterns), strict=True):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(i, i + 1) for i in range(50, 70)] + [(None, 3), (3, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups({x for link in real for x in link}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "short phrase"), (2, None), (3, "..."), (None, "no id here"), (4, "short phrase")]
    texts = ["", None, "a b " + items[0][1].upper() + " c", "x short-PHRASE y short phrase", "no id here", "short", "é" * 50, "alpha beta gamma delta epsilon zeta eta theta iota other"]
    texts += [" ".join(rng.choice(["short", "phrase", "alpha", "beta"]) for _ in range(40)) for _ in range(10)] + ["short phrase " * 3000]
    docs = spark.createDataFrame([(i, x, i, i) for i, x in enumerate(texts)] + [(2, texts[2], 0, 0), (None, texts[3], 0, 0)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(docs, bench, ["doc_id", "text"]).collect()
    assert len(got) == len(texts) + 2
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9)) if w]
    for r in got:
        w, hit, found = words(r.text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} - {"None"}
        assert r.n_words == len(w) and sorted(r.item_ids) == sorted(found)
        assert {i for s in r.spans for i in range(s.start, s.end)} == hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    cleaned = {r.doc_id: r.text for r in decontamination.remove_spans(docs.where("doc_id is not null"), bench).collect()}
    assert cleaned[1] is None and cleaned[2] == "a b  c" and cleaned[3] == "x  y " and cleaned[4] == "" and cleaned[7] == texts[7]
    assert decontamination.scan(docs.where("false"), bench, ["doc_id"]).count() == 0
    assert decontamination.scan(docs, bench.where("false"), ["doc_id"]).where("size(item_ids) > 0").count() == 0


def test_decontamination_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_BYTES", 20)
    bench = spark.createDataFrame([(i, f"p{i} q{i} r{i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "p1 q1 r1 p2 q2 r2 z p8 q8 r8", 0, 0)], DOCS)
    row = decontamination.scan(docs, bench, ["doc_id"]).first()
    assert [(s.start, s.end) for s in row.spans] == [(0, 6), (7, 10)] and sorted(row.item_ids) == ["1", "2", "8"]


def test_decontamination_cuts_the_united_spans(spark, monkeypatch):
    """Overlapping items of different passes: every pass sees the original text, and what stays is what scan does not cover."""
    monkeypatch.setattr(decontamination, "PASS_BYTES", 20)
    letters = "abcdefghijklmno"
    items = [(i, " ".join(f"w{x}" for x in letters[i : i + 3])) for i in range(0, 14, 2)] + [(20, "left right")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(f"w{x}" for x in letters), "keep left wa wb wc right keep", "x wa wb wc wd we y wg wh wi z", None, "", "nothing"]
    docs = spark.createDataFrame([(i, x, i, i) for i, x in enumerate(texts)], DOCS)
    assert len({r[0] for r in bench.select(F.pmod(F.xxhash64("text"), F.lit(sum(len(t) for _, t in items) // 20 + 1))).collect()}) > 1
    cleaned = {r.doc_id: r for r in decontamination.remove_spans(docs, bench).collect()}
    for i, x in enumerate(texts):
        w, hit = (x or "").split(), set()
        for _, item in items:
            p = item.split()
            hit |= {j for at in range(len(w)) if w[at : at + len(p)] == p for j in range(at, at + len(p))}
        assert cleaned[i].spans == i and (cleaned[i].text or "").split() == [y for j, y in enumerate(w) if j not in hit]
    assert cleaned[1].text.split() == ["keep", "left", "right", "keep"] and cleaned[3].text is None and cleaned[0].text == ""


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    rows = []
    for i in range(260):
        v = base[i % 20] + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.05, 0.2, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, rows[0][1], None), (304, [None] + [1.0] * 15, 1), (305, rows[0][1][:8], 0), (306, [], 0), (307, [2 * x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v and None not in v and lab is not None and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and fine[a][0] @ fine[b][0] / math.sqrt((fine[a][0] @ fine[a][0]) * (fine[b][0] @ fine[b][0])) >= 0.98]
    want = groups([r[0] for r in rows], links)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert len(links) > 100 and {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in x for x in links) for i in got}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_warc(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\n"
    rows = [(5, "http://A.example/x?b#c", "same"), (3, "http://b.example/", "same"), (9, None, None), (8, "no scheme", ""), (7, "http://c\r\nx/", tricky), (6, "http://www.c/", "é" * 1000), (4, "http://d/", tricky), (3, "http://b.example/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, _ = warc.archive(pages)
    got = index.collect()
    assert len(got) == len(rows)
    least = {}
    for page, _, html in rows:
        least[html or ""] = min(page, least.get(html or "", 99))
    texts = {page: html or "" for page, _, html in rows}
    for r in got:
        body = texts[int(r.page_id)]
        again = least[body] != int(r.page_id)
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        assert r.record_type == ("revisit" if again else "response") and r.refers_to == (str(least[body]) if again else None)
    key = [(r.url_key, r.captured, r.page_id) for r in sorted(got, key=lambda r: r.part)]
    assert key == sorted(key)
    assert warc.archive(pages.where("false"))[0].count() == 0
    assert warc.archive(pages, least_bytes=10**6)[0].where("record_type = 'revisit'").count() == 0


def test_archives_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    sizes = [10] * 200 + [3000] * 40 + [15_000] * 5 + [90_000, 0]
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * n + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    index, path = warc.archive(pages)
    rows = index.collect()
    assert sorted((int(r.page_id), r.payload_bytes) for r in rows) == [(i, n + len(str(i))) for i, n in enumerate(sizes)]
    files = {}
    for r in rows:
        files.setdefault(r.archive, []).append(r.length)
    assert all(sum(x) <= 20_000 + 300 * len(x) or len(x) == 1 for x in files.values()) and len(files) < 80


def test_loser_tree():
    rng = random.Random(5)
    for _ in range(100):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(7))]
        assert list(warc.loser_tree([iter(r) for r in runs], key=lambda x: x)) == sorted(sum(runs, []))


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_distances_of_unlike_lengths_are_computed_together(monkeypatch):
    rng = random.Random(3)
    a = ["".join(rng.choice("abcdé漢") for _ in range(rng.choice([20, 63, 64, 65, 128, 129, 400]))) for _ in range(60)]
    b = ["".join(rng.choice("abcdé漢") if rng.random() < 0.3 else c for c in x if rng.random() > 0.1) + "xy" for x in a]
    wanted = [line_dedup._one_distance(*line_dedup._trimmed(x, y)) for x, y in zip(a, b, strict=True)]
    alone, one = [], line_dedup._one_distance
    monkeypatch.setattr(line_dedup, "_one_distance", lambda x, y: alone.append(len(x)) or one(x, y))
    assert line_dedup.edit_distances(a, b).tolist() == wanted
    assert len(alone) <= line_dedup.TOGETHER


@pytest.mark.parametrize("part", [1 << 17, 16])
def test_meetings_are_all_shared_blocks(spark, monkeypatch, part):
    """Blocks reach their shares in few rows; the nodes of very large ones are dealt on, and none is lost."""
    monkeypatch.setattr(line_dedup, "LOOK", 1)
    monkeypatch.setattr(line_dedup, "PART", part)
    rng = random.Random(5)
    blocks = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    lines = [(n, 20 + n % 7, [blocks[0], *rng.sample(blocks, 2), rng.getrandbits(64) - (1 << 63)]) for n in range(200)]
    lines += [(n, 20 + n % 7, b) for n, _, b in lines[:20]] + [(500, 9, [])]
    table = line_dedup.written(spark.createDataFrame(lines, "node long, size int, blocks array<long>").repartition(3), "lines")
    got = line_dedup.meetings(table).collect()
    nodes = defaultdict(set)
    for n, size, its in lines:
        for x in its:
            nodes[x].add((n, size))
    assert sorted((r.sig, r.node, r.size) for r in got) == sorted((x, *n) for x, its in nodes.items() if len(its) > 1 for n in its)
    assert all((r.leader, r.leader_size) in nodes[r.sig] and r.leader <= r.node for r in got)
    parts = len({r.leader for r in got if r.sig == blocks[0]})
    assert parts == 1 if part > 250 else 1 < parts <= 250 // part
    assert all(r.leader == min(nodes[r.sig])[0] for r in got if r.sig != blocks[0])


def test_small_tables_are_read_by_fewer_tasks(spark):
    table = line_dedup.written(spark.range(1000).repartition(40), "rows")
    before, after = table.rdd.getNumPartitions(), common.fewer(table)
    assert before > 1 and after.rdd.getNumPartitions() == -(-before // 4) and after.count() == 1000
    assert common.fewer(line_dedup.written(spark.range(0), "rows")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(7)
    long = " ".join(f"Paragraph{rng.randrange(99)}" for _ in range(60))
    texts = ["one two three\nfour five six", "ONE, two 'three'!\nnew words only here", None, "", "\n\n", "a b\na b", long + "\nend of this", "x\n" + long.replace("Paragraph", "paragraph", 5) + ".", "one two three\none two three", "total 12 of 34", "total 56 of 78"]
    docs = spark.createDataFrame([(i, x, i, i) for i, x in enumerate(texts)] + [(None, "one two three", 0, 0)], DOCS)
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert got[None].text == "one two three" and got[0].text == "four five six" and got[1].text == "new words only here"
    assert got[2].text is None and got[3].text == "" and got[4].text == "\n\n" and got[5].text == "a b\na b"
    assert got[6].text == texts[6] and got[7].text == "x" and got[8].text == "" and got[8].removed == 2
    assert got[9].text == texts[9] and got[10].text == "" and got[9].spans == 9
    assert line_dedup.dedup(docs.where("false")).count() == 0


def test_line_dedup_of_all_lines_with_a_word(spark, tmp_path):
    """Lines of one or two words go as soon as they stand again; near copies are bounded in characters, not bytes or words."""
    chinese = "".join(chr(0x4E00 + i) for i in range(40))
    texts = ["les\nand ornd\n--\n", "LES\nand ornd.\n--\n\nles", chinese, chinese + "\n本", "本", "ab\nac\nab", None]
    docs = spark.createDataFrame([(i, x, i, i) for i, x in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in range(7)] == [0, 3, 0, 1, 1, 1, 0]
    assert [got[i].text_sha256 for i in range(6)] == [hashlib.sha256(x.encode()).hexdigest() for x in [texts[0], "--\n", chinese, "本", "", "ab\nac"]]
    named = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"), F.col("text").alias("body"))
    assert {r.size for r in line_dedup.line_table(named.where("doc = 2"), 1).collect()} == {40}


def _near_lines(rng, n, least, most):
    """Base lines, and copies with up to a tenth of their words changed, put in or left out."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 11)))
    base = [[word() for _ in range(rng.randrange(least, most))] for _ in range(n // 5)]
    lines = [" ".join(w) for w in base]
    while len(lines) < n:
        w = list(rng.choice(base))
        for _ in range(max(1, rng.randrange(len(w) // 10 + 1))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[word()], [word()], [w[at], word()], []])
        lines.append(" ".join(w))
    return lines


def _blocks_of(lines):
    data, offsets = np.frombuffer("\n".join(lines).encode(), np.uint8), np.array([0, len("\n".join(lines).encode())])
    found, first, _, _ = line_dedup._lines(data, offsets)
    _, _, h, count = line_dedup._nodes(found, first)
    h, letters, line = line_dedup._features(found, h, np.repeat(np.arange(len(first)), count))
    of, block = line_dedup.blocks(h, letters, line, len(first))
    out = [set() for _ in lines]
    for i, x in zip(of, block, strict=True):
        out[i].add(int(x))
    return out


@pytest.mark.parametrize("least,most", [(4, 8), (8, 13), (13, 24), (24, 60), (60, 150), (150, 400)])
def test_line_blocks_reach_near_copies(least, most):
    """Of all pairs of lines with an edit similarity of 0.8 or more, nine of ten share a block, in each class of length."""
    lines = sorted({x for x in _near_lines(random.Random(least), 150, least, most) if len(x) >= line_dedup.LEAST_SIZE})
    held = _blocks_of(lines)
    near = [(a, b) for a in range(len(lines)) for b in range(a) if line_dedup.edit_distance(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b]))]
    assert len(near) > 80 and sum(bool(held[a] & held[b]) for a, b in near) >= 0.9 * len(near)


def test_line_blocks_hold_one_changed_word():
    rng = random.Random(20)
    for n in (4, 5, 7, 9, 10, 12, 40, 100, 250):
        for _ in range(20):
            w = ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]
            other = [*w]
            other[rng.randrange(n)] = "other"
            a, b, again = _blocks_of([" ".join(w), " ".join(other), " ".join(reversed(w))])
            assert a & b and a == again
    text = "".join(chr(0x4E00 + i * 7) for i in range(60))
    a, b = _blocks_of([text, text[:30] + "一" + text[31:]])
    assert a & b


def test_line_groups_equal_all_pairs(spark, monkeypatch):
    """The groups are those that a shared block and the edit similarity give over all pairs of lines, hot blocks too."""
    monkeypatch.setattr(line_dedup, "LOOK", 1)
    rng = random.Random(8)
    lines = _near_lines(rng, 160, 5, 70) + ["the same words all over " * 3 + f"and x{chr(97 + i)}" for i in range(26)] + ["short", "short", "two words", "x " * 3000]
    docs = spark.createDataFrame([(i, x, 0, 0) for i, x in enumerate(lines)], DOCS)
    named = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"), F.col("text").alias("body"))
    table, keepers = line_dedup.groups(named, least_words=1)
    node = {r.doc: r.node for r in table.collect()}
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(x, i)
    held = _blocks_of([x if len(x) >= line_dedup.LEAST_SIZE else "x" for x in lines])
    near = lambda a, b: line_dedup.edit_distance(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b]))
    distinct = sorted(first.values())
    links = [(a, b) for a in distinct for b in distinct if a < b and held[a] & held[b] and near(a, b)]
    want = groups(range(len(lines)), links + [(first[x], i) for i, x in enumerate(lines) if first[x] != i])
    by_node = {r.node: r.keeper.doc for r in keepers.collect()}
    assert len(links) > 50 and {i: by_node.get(node[i], i) for i in node} == want


def test_line_dedup_clashing_names(spark):
    rows = [(1, "a b c\nd e f", 5, 6, 7, 8), (2, "a b c", 1, 2, 3, 4), (2, "a b c", 1, 2, 3, 4), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines int, removed int, split int, gone int")
    got = sorted(line_dedup.dedup(docs).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.lines_, r.removed_, r.text, r.lines, r.removed, r.split, r.gone) for r in got] == [(0, 0, None, None, None, None, None), (2, 0, "a b c\nd e f", 5, 6, 7, 8), (1, 1, "", 1, 2, 3, 4), (1, 1, "", 1, 2, 3, 4)]


def test_license_scan(spark):
    texts = ["Released under the MIT License.", None, "", "mit. license of the Apache license", "This work is licensed under the GNU General Public License, version 3. " * 3, "Licensed under CC BY-NC 4.0.", "Licensed under nothing by 4", "general public", "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:", "license " * 2000 + "mit license"]
    docs = spark.createDataFrame([(i, x, i, i) for i, x in enumerate(texts)] + [(0, texts[0], 0, 0), (None, texts[5], 0, 0)], DOCS)
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got}
    for i, x in enumerate(texts):
        w = words(x)
        hits = sorted(at for p in license_scan.PHRASES.values() for at in range(len(w)) if w[at : at + len(p)] == p)
        assert by[i].n_words == len(w) and by[i].base_starts == hits
    assert by[0].labels == ["mit"] and by[5].labels == ["cc-by-nc"] == by[None].labels and by[6].labels == [] and by[8].labels == ["bsd"] and 0.9 <= by[8].score < 1
    assert by[3].labels == ["apache", "mit"] and by[4].labels == ["gpl"] and by[1].score == 0
    assert license_scan.scan(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_packing(spark, tokenizer):
    path, whole = tokenizer
    rng = random.Random(9)
    texts = ["", None, "Héllo, WORLD's <|endoftext|> 12ab ΣΑΣ İx ªº² a\u0301\u00a0b 中文字", "it's,'s don't!!", "ⅷ ǅ ß ẞ"] + [" ".join("".join(rng.choice("abcdeé.,'0-") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 1500))) for _ in range(60)]
    docs = spark.createDataFrame([(i, x, 0, 0) for i, x in enumerate(texts)] + [(5, texts[5], 0, 0), (None, "x", 0, 0)], DOCS)
    pieces = packing.tokenize(docs, path, ["doc_id"], length=512)
    done = packing.pack(pieces, size=512).collect()
    for r in done:
        ids = whole.encode(texts[r.doc_id] or "" if r.doc_id is not None else "x", add_special_tokens=False).ids + [0]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.start : r.start + r.length] and r.start == 512 * r.piece
        assert r.length == min(512, len(ids) - r.start)
    places = {}
    for r in done:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= sum(r.length for r in done) / 512 * 1.05 + 1
    assert packing.pack(pieces.where("false"), size=512).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(10)
    for _ in range(20):
        counts = np.zeros(65, np.int64)
        np.add.at(counts, rng.integers(1, 65, rng.integers(0, 300)), 1)
        plan = packing.Plan(counts, 64)
        used = np.zeros(65, np.int64)
        for lengths, times in plan.patterns:
            assert sum(lengths) <= 64 and times > 0
            np.add.at(used, lengths, times)
        assert (used == counts).all()
        total = int((counts * np.arange(65)).sum())
        assert sum(t for _, t in plan.patterns) <= math.ceil(total / 64) * 1.25 + 1


def test_language_id(spark):
    rng = random.Random(11)
    syllables = {"aa": ["ko", "ra", "mi", "tu"], "bb": ["schn", "brt", "zw", "pf"], "ru": ["до", "ма", "ки", "ло"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang, rng.randrange(5, 40)), lang) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(240))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!!", None), (1003, say("aa", 30) + " " + say("bb", 60), None), (1004, say("ru", 5000), None), (None, say("bb", 9), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language_id.identify(docs, model, ["doc_id"]).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    mixed = got[1003]
    assert mixed.lang_pred == "bb" and [s.lang for s in mixed.spans] == ["aa", "bb"] and abs(mixed.spans[0].end - 30) <= 2 and got[1004].lang_pred == "ru"
    none = language_id.train(docs.where("false"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language_id.identify(docs, none, ["doc_id"]).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(12)
    import itertools

    scores = rng.normal(size=(11, 3)).astype(np.float32) * 3
    first = np.array([0, 4, 4, 5, 11])
    label = language_id.viterbi(scores, first, 2.0)
    value = lambda path, s: sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = max((value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(label[a:b], scores[a:b]) == pytest.approx(best, abs=1e-4)


def test_viterbi_of_many_languages():
    scores = np.full((400, 200), -9, np.float32)
    want = np.repeat(np.arange(200), 2)
    scores[np.arange(400), want] = 0
    assert (language_id.viterbi(scores, np.array([0, 400]), 1.0) == want).all()


def test_quality(spark):
    rng = random.Random(13)
    good = lambda: ". ".join(" ".join(rng.choice(["the", "river", "of", "stones", "was", "calm", "and", "wide"]) for _ in range(9)).capitalize() for _ in range(rng.randrange(2, 9)))
    bad = lambda: " ".join(rng.choice(["CLICK!!", "a|b|c", "$$$", "###", "x9x9"]) for _ in range(rng.randrange(5, 80)))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == bool(i % 2) for i in held) >= 0.95 * len(held)
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in got.values()) and got[1000] == got[1001]
    assert {r.score for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score(docs.where("false"), labels).count() == 0


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1]))
    assert got.tolist() == [0, 2 / 3, 2 / 3, 1]


@pytest.mark.parametrize("size,percent,seed", [(4, 85, 14), (5, 80, 15), (2, 50, 16)])
def test_jaccard(spark, monkeypatch, size, percent, seed):
    monkeypatch.setattr(components, "LARGE", 6)
    monkeypatch.setattr(jaccard, "FREQUENT", 0.05)
    rng = random.Random(seed)
    texts = random_texts(rng, 150) + ["", None, "one", "one", "One two", "one two", "\u00a0x"]
    docs = spark.createDataFrame([(i, x, 0, 0) for i, x in enumerate(texts)] + [(None, texts[0], 0, 0), (7, "another text with this id here", 0, 0)], DOCS)
    got = [r for r in jaccard.join(docs, size=size, percent=percent).collect()]
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(range(len(texts)), links)
    assert len(got) == len(texts) + 2 and len(links) > 20
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        elif r.doc_id != 7:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_lines_of_one_first_hash_are_told_apart(spark):
    docs = spark.createDataFrame([(0, 1, "alpha beta gamma delta epsilon\nalpha beta gamma delta epsilom"), (1, 1, "one two three four five six seven"), (2, 1, "one two three four five six seven")], "doc int, print long, body string")
    lines = line_dedup.written(line_dedup.line_table(docs, 1), "lines")
    first = lines.where("doc = 0 AND line = 0").first()
    forced = line_dedup.written(lines.withColumn("node", F.when(F.col("doc") > 0, first.node).otherwise(F.col("node"))), "lines")
    told, keepers = line_dedup.keepers_of(docs, forced)
    assert told.select("node").distinct().count() == 3
    again = told.join(keepers, "node").where(~F.struct("doc", "print", "line").eqNullSafe(F.col("keeper")))
    assert {(r.doc, r.line) for r in again.collect()} == {(0, 1), (2, 0)}


def test_url_filter(spark):
    urls = ["https://a.Example.com/en/7x", "http://example.com/en/8", "http://x.net/de/1", "http://q.example.net/de/8?x", "http://example.net/de/9", "http://b.org/es/", "http://b.org/es", None, "nothing", "http://", "a://b#c", "http://notcom/en/", "://com/en/#", "http://c.de/" + "a/" * 40]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(1, urls[1], "z"), (None, urls[2], "z")], "page_id long, url string, host string")
    got = url_filter.judge(pages, RULES, ["page_id"]).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[r.page_id] if r.page_id is not None else urls[2]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.where("false"), RULES, ["page_id"]).count() == 0


def test_url_templates(spark):
    rows = [(i, f"http://h.de/shop/{i}/item", True) for i in range(40)] + [(100 + i, f"http://h.de/blog/{i}", False) for i in range(40)] + [(200 + i, f"http://h.de/p/{''.join(random.Random(i).choices('ghijkl', k=6))}/x", i % 2 == 0) for i in range(40)] + [(300, "http://h.de/shop/999/item", None), (301, "http://h.de/blog/999", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, [], ["page_id"], rejected=F.col("bad")).collect()}
    assert got[300].template == "/shop/{n}/item" and got[300].verdict == "block" and got[301].verdict == "allow"
    assert got[200].template == "/p/*/x" and 0.4 < got[200].purity < 0.6


def test_url_tree_goes_as_deep_as_branches_are_shared(spark):
    deep = "/".join("abcdefgh")
    rows = [(i, f"http://h.de/{deep}/{i}/end", i < 30) for i in range(60)] + [(100 + i, f"http://h.de/{deep}/x{i}y", None) for i in range(15)] + [(200, "http://one.de/" + "/".join(["s"] * 3000), None)]
    rows += [(300 + 30 * n + i, f"http://k.de/{part}/{i}", i % 3 == 0) for n, part in enumerate(("red", "blue", "green")) for i in range(30)] + [(400 + i, f"http://l.de/odd/{i}/more", True) for i in range(30)]
    pages = spark.createDataFrame([(*r, "given") for r in rows], "page_id long, url string, bad boolean, host string")
    judged = url_filter.judge(pages, [], ["page_id", "host"], rejected=F.col("bad"))
    assert judged.columns == ["page_id", "host", "host_", "path", "rule", "template", "purity", "verdict"]
    got = {r.page_id: r for r in judged.collect()}
    assert got[0].template == f"/{deep}/{{n}}/end" and {got[100 + i].template for i in range(15)} == {f"/{deep}/*"}
    assert got[200].template == "/" + "/".join(["s"] * 3000) and got[0].host == "given" and got[0].host_ == "h.de"
    assert {got[300 + i].template for i in range(90)} == {"/+/{n}"} and got[400].template == "/odd/{n}/more"


def test_url_purities(spark):
    """The chain of wider groups against a plain recomputation; pages without a rule get both verdicts by evidence."""
    rng = random.Random(21)
    rows = []
    for host in ("a.x.com", "b.x.com", "y.com", "z.de", "localhost", ""):
        for template in ("", "/de/{n}", "/en/{n}", "/en/*/q", "/+"):
            labelled = rng.choice([0, 0, 3, 20])
            rows.append((host, template, labelled, rng.randrange(labelled + 1)))
    tree = spark.createDataFrame([*rows, rows[0]], "host string, template string, labelled long, rejected long")
    got = {(r.host, r.template): r.purity for r in url_filter.purities(tree, (1.0, 3.0), 4.0).collect()}
    rows.append(rows[0])
    domain = lambda h: ".".join(h.split(".")[-2:])
    for host, template in got:
        purity = 0.25
        groups_ = [lambda h, t: h.split(".")[-1] == host.split(".")[-1] and t == template, lambda h, t: domain(h) == domain(host) and t == template]
        parts = template.split("/")
        for i in range(1, len(parts) + 1):
            branch = parts[:i]
            groups_.append(lambda h, t, branch=branch: h == host and t.split("/")[: len(branch)] == branch)
        for inside in groups_:
            mine = [(n, k) for h, t, n, k in rows if inside(h, t)]
            purity = (sum(k for _, k in mine) + 4 * purity) / (sum(n for n, _ in mine) + 4)
        assert got[host, template] == pytest.approx(purity)
    pages = spark.createDataFrame([(i, f"http://{h}/en/{i}") for i, h in enumerate(["s.com"] * 30 + ["t.net"] * 30)] + [(90, "http://s.com/fr/1"), (91, "http://t.net/fr/1")], "page_id long, url string")
    rules = [url_filter.Rule("com", "/en/", "block"), url_filter.Rule("net", "/en/", "allow")]
    by = {r.page_id: r for r in url_filter.judge(pages, rules, ["page_id"]).collect()}
    assert (by[90].verdict, by[91].verdict, by[90].rule) == ("block", "allow", None)
    assert url_filter.purities(tree.where("false"), (1.0, 3.0), 4.0).count() == 0


def test_words_are_encoded_as_the_tokenizer_does_without_a_call_each():
    import random
    import sys
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    from timeloom.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(3)
    letters = "aZb\u00e9\u00c9\u00df\u1e9e\u0130\u0131\u03a3\u03c2K\u212a\u212b\u01c5\u01c6\u00aa\u01bb.!?,'\u2019-_09\u00b2 \n\t\u00a0\u0307e\u0301\u4e2d[]{}~`@#\x1c"
    texts = ["", " "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1000)]
    want = [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    encoded = [t.encode() for t in texts]
    assert [packing._ids_of(path, encoded) for _ in range(2)] == [want, want] and packing._ids_of(path, []) == []
    words = ["".join(rng.choice("abc\u00e9") for _ in range(12)).encode() for _ in range(2000)]
    calls = []
    sys.setprofile(lambda frame, event, arg: event == "call" and calls.append(1))
    packing._ids_of(path, [b" ".join(words)])
    sys.setprofile(None)
    assert len(calls) < len(words) // 2
