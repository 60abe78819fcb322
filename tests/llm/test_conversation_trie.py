"""The prefix trie against a plain one: shared beginnings, long and repeated conversations, nulls, ties, turnless and single ones, small shards and tiles."""

import hashlib
import math
import random
import re
import zlib

from timeloom.llm import conversation_trie as C
from timeloom.llm.queries import op11_conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, place int, hi string"


def rebuilt(rows):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, rows = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        rows.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def check(spark, path, rows, **sizes):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    found = op11_conversation_trie(spark, str(path), **sizes)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in found.collect()]
    assert len(found) == len(set(found)) and set(found) == (plain(rebuilt(rows)) if rows else set())


def test_trie_equals_a_plain_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 2)
    rng = random.Random(9)
    rows = []
    for c in [*range(45), *range(60, 75), -3, 10**15]:
        n = rng.choice([0, 1, 1, 2, 4, 9, 14])
        first = rng.choice(["a", "b c"])
        rows += [(c, t + 1, rng.choice(["user", None, "user"]) if t > 6 else "user", (first if t < 8 else rng.choice(["x y", "", None, "z"])), 1, "h") for t in range(n)]
    rows += [(7, None, "system", "s", 1, "h"), (None, 0, "user", "lost", 1, "h")]
    rows += [(70, 3, "user", "same words here", 1, "h")] * 10
    check(spark, tmp_path, rows, shard=5, tile=3)


def test_trie_of_few_rows(spark, tmp_path):
    check(spark, tmp_path, [])
    check(spark, tmp_path, [(2, 0, "user", "one", 1, "h")])


def test_places_go_on_between_tasks(spark):
    rows = [(1, i // 3, "user", f"t {i % 3}") for i in range(400)] + [(2, 0, None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = C.numbered(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.place for r in found if r.conv == 1) == list(range(400)) and [(r.place, r.words) for r in found if r.conv == 2] == [(0, 0)]
