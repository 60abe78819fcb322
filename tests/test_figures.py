"""Edge cases of figures and of range operators that meet in buckets."""

from timeloom.operators import figures, frames, intervals, lines


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_subtract_equals_brute_force(spark):
    spans = [(1, 1, 0, 100), (1, 2, 30, 40), (1, 2, 30, 40), (1, 3, 95, 260), (2, 4, 0, 10), (None, 5, 0, 10), (1, 6, 5, 5)]
    cuts = [(1, 10, 20), (1, 20, 25), (1, 90, 120), (1, 200, 210), (1, 35, 36)]
    gone = {t for _, a, b in cuts for t in range(a, b)}
    want = []
    for rec, i, a, b in spans:
        free = [t for t in range(a, b) if rec != 1 or t not in gone]
        begins = [t for t in free if t - 1 not in free]
        want += [(i, t, next(x for x in range(t, b + 1) if x not in free)) for t in begins]
    found = intervals.subtract(spark.createDataFrame(spans, "rec long, id long, a long, b long"), spark.createDataFrame(cuts, "rec long, a long, b long"), width=16)
    assert rows(found, "id", "a", "b") == sorted(want)


def test_slices_and_gaps(spark):
    old, new = (spark.createDataFrame(x, "rec long, at long") for x in ([(1, 1000), (2, 5000)], [(1, 1350), (1, 1351), (1, 650), (2, 1000), (1, -400)]))
    assert rows(lines.slice_at(old, new), "rec", "at") == [(1, -400), (1, 1000), (1, 1351), (2, 1000), (2, 5000)]
    points = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 99), (1, 5, 100)], "rec long, id long, t long")
    total = spark.createDataFrame([(1, 0, 100)], "rec long, low long, high long")
    held = spark.createDataFrame([(1, 10, 20)], "rec long, a long, b long")
    assert rows(intervals.free_gap(points, held, total), "id", "gap_a", "gap_b") == [(1, 0, 10), (3, 20, 100), (4, 20, 100)]


def test_figures_without_rows_and_with_nulls(spark):
    levels = spark.createDataFrame([(1, w, e) for w, e in enumerate([5, 9, None, 7])], "rec long, win long, energy long")
    assert rows(frames.index_values(levels, "energy", low=0.0, high=0.74), "low", "high") == [(5, 9)]
    assert figures.curve(levels.where("false").selectExpr("rec", "win AS at", "energy AS v")).count() == 0
    one = spark.createDataFrame([(1, 7, 3)], "rec long, at long, v long")
    assert figures.curve(one).count() == 0
    texts = spark.createDataFrame([(1, 1, "a cat, a cat"), (1, 2, None), (1, 3, "concat")], "rec long, id long, text string")
    fixes = spark.createDataFrame([(1, i, n, w, r) for i in (1, 2, 3) for n, w, r in [(1, "cat", "$1 dog"), (2, "cat", "cow")]], "rec long, id long, nth int, wrong string, right string")
    assert rows(figures.corrected(texts, fixes).where("text IS NOT NULL"), "id", "text", "applied") == [(1, "a $1 dog, a cow", 2), (3, "concat", 0)]
