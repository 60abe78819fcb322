"""Junctions, spaced events, row steps, steady windows, phrases and fingerprints against plain loops."""

import random
import statistics

from timeloom.operators import seams


def junctions(level, ranges, reach, per_frame, floor, apart):
    """One junction after the other."""
    ranges, found, n = [list(r) for r in ranges], [], len(level)
    for i in range(len(ranges) - 1):
        (a, b), (c, d) = ranges[i], ranges[i + 1]

        def grid(t, low, high):
            return [(f, abs(f - t)) for f in range(low, high)] if high > low else [(max(0, min(t, n - 1)), 0)]

        best = None
        for o, do in grid(b, max(0, b - reach, b - (b - a) * 4 // 10), min(n - 1, b + reach)):
            for e, de in grid(c, max(0, c - reach), min(n - 1, c + reach, c + (d - c) * 4 // 10)):
                cost = 4 * abs(level[o] - level[e]) + level[o] + level[e] + 4 * per_frame * (do + de)
                if e > o and (best is None or (cost, o, e) < best):
                    best = (cost, o, e)
        kept = best is not None and max(level[best[1]], level[best[2]]) <= floor and abs(level[best[1]] - level[best[2]]) <= apart
        found.append((i, best and best[1], best and best[2], kept))
        if kept:
            ranges[i][1], ranges[i + 1][0] = best[1:]
    return found, ranges


def joined(found, ranges, least):
    out, i = [], 0
    while i < len(ranges):
        a, b = ranges[i]
        while i < len(found) and not found[i][3]:
            i += 1
            b = ranges[i][1]
        out.append([a, b])
        i += 1
    for x, y in zip(out, out[1:], strict=False):
        y[0] = max(y[0], x[1])
    return [(a, b) for a, b in out if b - a > least]


def test_junctions_and_rejoined_ranges(spark):
    rng = random.Random(3)
    frames, ranges, want, want_ranges = [], [], set(), []
    for rec in range(25):
        level = [rng.randrange(-6000, -2000, 50) for _ in range(90)]
        cuts = sorted(rng.sample(range(90), 12)) if rec else [0, 2, 2, 4, 4, 5, 50, 51, 51, 60, 60, 89]
        mine = list(zip(cuts[::2], cuts[1::2], strict=True))[: rng.choice([1, 4, 6])]
        found, moved = junctions(level, mine, 12, 3, -3000, 700)
        frames += [(rec, k, v) for k, v in enumerate(level)]
        ranges += [(rec, i, a, b) for i, (a, b) in enumerate(mine)]
        want |= {(rec, *f) for f in found}
        want_ranges += [(rec, a, b) for a, b in joined(found, moved, 1)]
    levels = spark.createDataFrame(frames, "rec long, k long, level long")
    given = spark.createDataFrame(ranges, "rec long, ord long, a long, b long")
    chosen = seams.settled(seams.junctions(levels, given, 12, 3, -3000, 700))
    assert {tuple(r) for r in chosen.select("rec", "ord", "leave", "enter", "kept").collect()} == want
    assert sorted(tuple(r) for r in seams.refined(given, chosen, 1).collect()) == sorted(want_ranges)
    assert any(w[4] for w in want) and not all(w[4] for w in want)


def test_spaced_events(spark):
    rng = random.Random(4)
    events = {(rec, k) for rec in range(6) for k in range(300) if rng.random() < [0.02, 0.1, 0.3, 0.6, 1, 0][rec]}
    want = set()
    for rec, k in sorted(events):
        last = max((x for r, x in want if r == rec), default=None)
        if last is None or k - last > 5:
            want.add((rec, k))
    df = spark.createDataFrame(sorted(events) + [(0, min(k for r, k in events if r == 0))], "rec long, k long")
    assert {tuple(r) for r in seams.spaced(df).collect()} == want
    assert seams.spaced(df.where("false")).count() == 0


def test_row_steps(spark):
    rng = random.Random(6)
    pictures = [(rec, o, [rng.randrange(100) + (80 if o == 2 and y > 30 else 0) for y in range(48)]) for rec in range(3) for o in range(5)] + [(9, 0, [1] * 10), (9, 1, [2] * 10)]
    found = {(r.rec, r.ord): r for r in seams.row_steps(spark.createDataFrame(pictures, "rec long, ord long, rows array<long>")).collect()}
    by = {(rec, o): rows for rec, o, rows in pictures}
    want = {}
    for (rec, o), rows in by.items():
        if (rec, o - 1) in by and len(rows) > 16:
            d = [abs(x - y) for x, y in zip(rows, by[rec, o - 1], strict=True)]
            gaps = [(abs(sum(d[:y]) / y - sum(d[y:]) / (len(d) - y)), -y) for y in range(8, len(d) - 8)]
            gap, at = max(gaps)
            want[rec, o] = (-at, gap, max(d) >= 30 and gap / max(sum(d) / len(d), 0.5) > 1.35)
    assert set(found) == set(want)
    assert all((found[k].at, found[k].torn) == (w[0], w[2]) and abs(found[k].gap - w[1]) < 1e-9 for k, w in want.items())


def test_phrases_and_windows(spark):
    rng = random.Random(8)
    pitch = [rng.choice([None, rng.randrange(-50, 50)]) if k % 3 == 0 else rng.randrange(-50, 50) for k in range(700)]
    frames = spark.createDataFrame([(1, k, p, k % 40) for k, p in enumerate(pitch)], "rec long, k long, pitch long, level long")
    spans = [(1, 0, 0, 40), (1, 1, 30, 300), (1, 2, 690, 693), (1, 3, 500, 510)]
    found = {r.id: r for r in seams.phrase_measures(frames, spark.createDataFrame(spans, "rec long, id long, a long, b long"), 12, 8, 15, 64).collect()}
    assert set(found) == {0, 1, 3}
    for _, i, a, b in spans:
        if i in found:
            voiced = [(k, pitch[k]) for k in range(a, b + 1) if pitch[k] is not None]
            last = voiced[-1][0]
            ending, front = [p for k, p in voiced if k >= last - 8], [p for k, p in voiced if last - 23 <= k < last - 8]
            step = statistics.median(ending) - statistics.median(front) if len(voiced) >= 8 and len(ending) >= 3 and len(front) >= 3 else None
            assert (found[i].frames, found[i].voiced, found[i].terminal_step) == (b - a + 1, len(voiced), step)
            x, y = zip(*[(k, p) for k, p in voiced if k >= last - 12], strict=True)
            assert abs(found[i].terminal_slope - statistics.linear_regression(x, y).slope) < 1e-9
    wave = [0] * 16 + [3 if k % 2 else -3 for k in range(32)] + [rng.randrange(-90, 90) for _ in range(32)] + [4, -4] * 16
    steady = seams.steady_windows(spark.createDataFrame([(1, k, v) for k, v in enumerate(wave)], "rec long, k long, v long"), part=4, wide=4, hop=2)
    assert {16, 24, 32, 80, 88, 96} <= {r.start for r in steady.collect()} and 0 not in {r.start for r in steady.collect()}
    assert seams.room_tone(steady).first().energy == 9 * 16


def test_fingerprints(spark):
    rows = [(r, o, f"t{o % 7}", None if o % 5 == 0 else o) for r in range(3) for o in range(150)]
    take = lambda rows, n=1: {x.rec: x.fingerprint for x in seams.fingerprint(spark.createDataFrame(rows, "rec int, ord int, say string, len int").repartition(n), ["rec"], "ord", ["say", "len"], 4).collect()}
    one = take(rows)
    assert one == take(rows[::-1], 7) and len(set(one.values())) == 1
    swapped = [(r, {3: 4, 4: 3}.get(o, o) if r == 1 else o, s, n) for r, o, s, n in rows]
    nulled = [(r, o, s, None if (r, o) == (2, 149) else n) for r, o, s, n in rows]
    assert [k for k, v in take(swapped).items() if v != one[k]] == [1] and [k for k, v in take(nulled).items() if v != one[k]] == [2]
