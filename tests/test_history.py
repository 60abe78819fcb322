"""Tables with a past, layers, masks, flow, reports and checks on hand-made cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.operators import bounds, history, reports
from timeloom.sources import documents

LINE = "rec long, id long, ord long, start long, end long, locked boolean, dropped boolean, len long, hold long"


def test_versions_and_their_way_back(spark):
    rows = [("a", 1, 0, "x"), ("a", 2, 0, "x"), ("a", 5, 0, None), ("a", 5, 1, "y"), ("a", 9, 0, None), ("b", 3, 0, "z")]
    past = history.versions(spark.createDataFrame(rows, "key string, at long, n int, name string"), ["key"], ["n"], ["name"])
    take = lambda df: sorted((r.key, r.version, r.name, r.valid_from, r.valid_to) for r in df.collect())
    assert take(past) == [("a", 1, "x", 1, 5), ("a", 2, "y", 5, 9), ("a", 3, None, 9, None), ("b", 1, "z", 3, None)]
    assert [r.name for r in history.as_of(past, F.lit(5)).where("key = 'a'").collect()] == ["y"]
    news = spark.createDataFrame([("a", 20, None), ("b", 2, "old"), ("c", 4, "new")], "key string, at long, name string")
    assert take(history.changed(past, news, ["key"], ["name"])) == sorted([*take(past), ("c", 1, "new", 4, None)])
    back = history.rolled_back(past, spark.createDataFrame([("a", 6, 30), ("b", 1, 30)], "key string, to long, at long"), ["key"], ["name"])
    assert take(back) == [("a", 1, "x", 1, 5), ("a", 2, "y", 5, 9), ("a", 3, None, 9, 30), ("a", 4, "y", 30, None), ("b", 1, "z", 3, None)]


def test_merge_then_unmerge_gives_the_table_back(spark):
    rows = [(1, i, i, 10 * i, 10 * i + 5, i in (4, 5), i == 7, 3, i % 2) for i in range(10)]
    lines = spark.createDataFrame(rows, LINE)
    runs = lines.select("rec", F.floor(F.col("id") / 2).alias("run"), "id")
    done, archive = history.merged(lines, runs)
    assert {r.id for r in done.collect()} == {0, 2, 4, 6, 7, 8}
    part, rest = history.unmerged(done, archive, spark.createDataFrame([(1, 0), (1, 0), (1, 7)], "rec long, id long"))
    assert {r.id for r in part.collect()} == {0, 1, 2, 4, 6, 7, 8} and {r.into for r in rest.collect()} == {2, 4, 8}
    back, rest = history.unmerged(done, archive, done.select("rec", "id"))
    assert sorted(map(tuple, back.select(*lines.columns).collect())) == sorted(rows) and rest.count() == 0


def test_layers_and_tidy_terms(spark):
    kind = T.StructType().add("a", "integer").add("s", T.StructType().add("x", "string").add("y", T.ArrayType(T.IntegerType())))
    rows = [((None, ("p", None)), (2, (None, [])), (3, ("r", [1]))), (None, (None, None), (3, ("r", [1])))]
    df = spark.createDataFrame(rows, T.StructType().add("top", kind).add("mid", kind).add("low", kind))
    found = [r.v.asDict(True) for r in df.select(history.layered(F.col("top"), F.col("mid"), F.col("low"), kind=kind).alias("v")).collect()]
    assert found == [{"a": 2, "s": {"x": "p", "y": []}}, {"a": 3, "s": {"x": "r", "y": [1]}}]
    terms = spark.createDataFrame([([" Tab", "tab ", "", None, "B"],), (None,)], "t array<string>")
    assert [r.t for r in terms.select(history.tidy(F.col("t")).alias("t")).collect()] == [["Tab", "B"], []]
    documents = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id int, deleted_at int")
    assert {tuple(r) for r in history.trashed(documents, documents.where("id < 3"), F.lit(9)).collect()} == {(1, 9), (2, 5), (3, None)}
    states = spark.createDataFrame([({"1": "open", "2": "open"}, ["2", "3"])], "m map<string,string>, ids array<string>")
    assert states.select(history.statuses(F.col("m"), F.col("ids"), F.lit("accepted")).alias("m")).first().m == {"1": "open", "2": "accepted", "3": "accepted"}


def test_reports(spark):
    rows = spark.createDataFrame([(1, 0, 5, None), (1, 1, 7, 2), (2, 0, 4, 4)], "id int, side int, lufs int, crest int")
    long = reports.long_metrics(rows, ["id", "side"], ["lufs", "crest"])
    found = {(r.id, r.metric): (r.before, r.after, r.delta, r.change) for r in reports.before_after(long.where("side = 0"), long.where("side = 1"), ["id"]).collect()}
    assert found == {(1, "lufs"): (5, 7, 2, "up"), (1, "crest"): (None, 2, None, None), (2, "lufs"): (4, None, None, "gone"), (2, "crest"): (4, None, None, "gone")}
    clips = spark.createDataFrame([(i, "one two three", 1.0 + i, "s") for i in range(20)], "audio int, text string, seconds double, source string")
    assert reports.kept_clips(clips, clips.where("false"), least=10).count() == 17
    with pytest.raises(ValueError, match="usable"):
        reports.kept_clips(clips, clips.where("false"))
    sound = spark.createDataFrame([(-700, 3, 1200), (-900, 1, 100)], "tail int, flat int, pause int")
    assert [r.n for r in sound.select(reports.noisy(F.col("tail"), F.col("flat"), F.col("pause")).alias("n")).collect()] == [["tail", "clipped", "pause"], []]
    ends = spark.createDataFrame([(2000, 1500), (2000, 1800), (2000, 500), (1000, None), (9000, 4000)], "length int, quiet int")
    assert [r.e for r in ends.select(reports.trimmed_end(F.col("length"), F.col("quiet")).alias("e")).collect()] == [1500, 2000, 2000, 1000, 9000]


def test_decibels_and_open_ends(spark):
    assert spark.range(1).select(bounds.decibels(F.lit(0.0), F.lit(0)).alias("a"), F.round(bounds.decibels(F.lit(32768.0**2 * 4), F.lit(4)), 6).alias("b")).first() == (-120.0, 0.0)
    points = spark.createDataFrame([(1, 5), (1, 7), (1, 10), (1, 11)], "rec long, t long")
    spans = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 4, 8), (1, 3, 9, 6)], "rec long, id long, a long, b long")
    assert {(r.t, r.span) for r in bounds.at_point(points, spans).collect()} == {(5, 1), (5, 2), (7, 1), (7, 2), (10, 1)}
    assert {(r.t, r.span) for r in bounds.at_point(points, spans, open_ends=True, first=True).collect()} == {(5, 2), (7, 2)}


def test_document_folders_and_lexicon(spark, tmp_path):
    folder = tmp_path / "projects"
    folder.mkdir()
    (folder / "a.json").write_text('{\n "id": "a", "createdAt": 5\n}')
    (folder / "b.json").write_text('{"id": "b",\n "createdAt": 9, "more": 1}')
    (folder / "c.json").write_text("{broken")
    assert [(r.id, r.createdAt) for r in documents.projects(spark, str(folder), "id string, createdAt long").collect()] == [("b", 9), ("a", 5)]
    terms = spark.createDataFrame([(2, "Tab "), (0, "Fable"), (3, "tab"), (1, " "), (4, None)], "place long, term string")
    documents.write_lexicon(terms, str(tmp_path / "lexicon"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lexicon")).collect()] == ["# one term a line", "Fable", "Tab"]
    assert {r[0] for r in documents.lexicon(spark, str(tmp_path / "lexicon")).collect()} == {"Fable", "Tab"}
    probe = spark.createDataFrame([('{"streams":[{"codec_type":"video","codec_name":"png"}]}',), ("no document",), (None,)], "p string")
    assert [r.s.codec for r in probe.select(documents.main_stream(F.col("p")).alias("s")).collect()] == [None, None, None]
