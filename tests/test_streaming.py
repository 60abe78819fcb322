"""Streams of files against the batch result on the same rows."""

import uuid

from pyspark.sql import functions as F

from timeloom.operators import detect
from timeloom.streaming import ordered

WORD = "rec long, idx long, w string, start_ms long, end_ms long, p_milli long"


def drain(stream, tmp_path):
    name = f"q{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def words(spark, tmp_path):
    rows, at = [], 0
    for i in range(60):
        at += 40 if i % 7 else 1500
        rows.append((i % 2, i, "w", at, at + 100, 900))
        at += 100
    frame = spark.createDataFrame(rows, WORD)
    for part in range(3):
        frame.where((F.col("idx") >= 20 * part) & (F.col("idx") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "words"))
    stream = spark.readStream.schema(WORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "words"))
    return frame, stream


def test_dead_air_equals_batch(spark, tmp_path):
    frame, stream = words(spark, tmp_path)
    got = drain(ordered.dead_air(stream), tmp_path)
    want = detect.dead_air(frame).select("rec", "idx", "start_ms", "end_ms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_sessions(spark, tmp_path):
    frame, stream = words(spark, tmp_path)
    timed = lambda df: df.where("rec = 0").select("rec", F.timestamp_millis("start_ms").alias("ts"))
    late = frame.agg(F.max("start_ms")).first()[0]
    batch = ordered.sessions(timed(frame))
    got = drain(ordered.sessions(timed(stream), late="0 seconds"), tmp_path)
    closed = {tuple(r) for r in batch.collect() if r.end.timestamp() * 1000 < late - 2000}
    assert closed and closed <= {tuple(r) for r in got.collect()} <= {tuple(r) for r in batch.collect()}


def test_changes_progress_and_answers(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('start\n{"step": 1}\n{"step": 2}\n{"st')
    got = drain(ordered.progress(spark, str(tmp_path / "log"), "step int"), tmp_path)
    assert sorted(r.step for r in got.collect()) == [1, 2]
    lines = spark.createDataFrame([("k", i, x) for i, x in enumerate("aabba")], "key string, n long, line string")
    lines.coalesce(1).write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    assert [r.n for r in drain(ordered.changes(stream), tmp_path).orderBy("n").collect()] == [0, 2, 4]
    asked = spark.createDataFrame([("1", "4"), ("2", "x")], "id string, text string")
    replies = {r.id: (r.reply, r.error) for r in ordered.answer(asked, lambda: lambda s: str(int(s) * 2)).collect()}
    assert replies["1"] == ("8", None) and replies["2"][0] is None and replies["2"][1].startswith("ValueError")


def test_progress_is_added_once_and_lines_are_bounded(spark, tmp_path):
    rows = [(f"k{i % 2}", i, f"step {i // 6}" if i % 2 else f"line {i}") for i in range(90)]
    frame = spark.createDataFrame(rows, "key string, n long, line string")
    for part in range(3):
        frame.where((F.col("n") >= 30 * part) & (F.col("n") < 30 * part + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    folder, ran = str(tmp_path / "progress"), []
    write = ordered.append_once(folder)

    def twice(batch, number):
        ran.append(number)
        write(batch, number)
        write(batch, number)

    query = stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = spark.read.parquet(folder)
    assert len(ran) == 3 and sorted(map(tuple, table.select("key", "n", "line").collect())) == sorted(rows)
    assert {(r.key, r.line) for r in ordered.latest_of(table, ["key"], ["line"]).collect()} == {("k0", "line 88"), ("k1", "step 14")}

    seen = str(tmp_path / "seen")
    query = ordered.last_lines(stream, most=8).writeStream.outputMode("update").foreachBatch(ordered.append_once(seen)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.key: list(r.lines) for r in ordered.latest_of(spark.read.parquet(seen), ["key"], ["lines"]).collect()}
    assert last == {"k0": [f"line {i}" for i in range(74, 90, 2)], "k1": [f"step {i}" for i in range(7, 15)]}
