"""Streams give what their batch forms give."""

import datetime as dt
import os
import time

from convlake.operators import search, stats
from convlake.streaming import jobs


def drain(stream, mode, name, where):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_perf_ema_stream(spark, tmp_path):
    rows = [(k, i, float((i * 7 + len(k)) % 11)) for k in ("a", "bb") for i in range(9)] + [("a", 9, None)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part or (part == 2 and r[1] == 9)], "key string, seq long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(jobs.perf_ema_stream(stream), "update", "ema", tmp_path / "ck")
    got = {r["key"]: round(r["v"], 9) for r in spark.sql("SELECT key, max_by(value, samples) AS v FROM ema GROUP BY key").collect()}
    batch = stats.perf_ema(spark.createDataFrame([r for r in rows if r[2] is not None], "key string, seq long, value double"))
    assert got == {r["key"]: round(r["value"], 9) for r in batch.collect()}


def test_finished_recordings(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    first = [("r1", at(0), 5), ("r1", at(20), 6), ("r2", at(10), 7)]
    later = [("r1", at(100), 1), ("r3", at(500), 1)]
    for part in (first, later):
        spark.createDataFrame(part, "rid string, ts timestamp, n_bytes long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rid string, ts timestamp, n_bytes long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(jobs.finished_recordings(stream), "append", "finished", tmp_path / "ck")
    got = {(r["rid"], r["bytes"], r["last"] - r["first"]) for r in spark.table("finished").collect()}
    second = dt.timedelta(seconds=1)
    assert got == {("r1", 11, 20 * second), ("r2", 7, 0 * second), ("r1", 1, 0 * second)}


def touch(path, age):
    path.write_text("x")
    os.utime(path, (time.time() - age,) * 2)


def test_watch_stream_hands_a_young_file_over_once_when_it_is_old_enough(spark, tmp_path):
    folder, got, ck = tmp_path / "in", [], str(tmp_path / "ck")
    folder.mkdir()
    for name, age in (("a.WAV", 60), ("b.txt", 60), (".c.mp3", 60), ("old.m4a", 10 * 365 * 86400)):
        touch(folder / name, age)

    def follow(seconds, enough=None):
        query = jobs.watch_stream(spark, str(folder), lambda new: got.extend((r["path"].rsplit("/", 1)[1], time.time()) for r in new.collect()), ck, settle_s=6).trigger(processingTime="1 second").start()
        until = time.time() + seconds
        while time.time() < until and not (enough and enough()):
            time.sleep(0.3)
            assert query.exception() is None
        query.stop()

    touch(folder / "young.mp3", 0)
    born = time.time()
    follow(60, lambda: len(got) == 3)
    assert [n for n, _ in got][:2] in (["a.WAV", "old.m4a"], ["old.m4a", "a.WAV"]) and got[2][0] == "young.mp3" and got[2][1] >= born + 5
    touch(folder / "later.ogg", 60)
    follow(60, lambda: len(got) == 4)
    follow(8)
    assert [n for n, _ in got][3:] == ["later.ogg"]


def test_baseline_and_import_existing(spark, tmp_path):
    folder, got, ck = tmp_path / "in", [], str(tmp_path / "ck")
    folder.mkdir()
    touch(folder / "a.mp3", 60)
    touch(folder / "b.mp3", 0)

    def once():
        files = jobs.watch_stream(spark, str(folder), lambda new: got.extend(r["path"].rsplit("/", 1)[1] for r in new.collect()), ck, settle_s=0)
        files.trigger(once=True).start().awaitTermination()

    jobs.baseline(spark, str(folder), ck)
    touch(folder / "c.mp3", 60)
    once()
    assert got == ["c.mp3"]
    jobs.import_existing(spark, ck)
    once()
    assert sorted(got[1:]) == ["a.mp3", "b.mp3", "c.mp3"]


def test_index_stream_takes_a_meeting_in_parts(spark, tmp_path):
    schema = "meeting_id string, idx long, version long, text string"
    parts = [
        [("a", 0, 1, "old words"), ("b", 0, 1, "kept"), ("a", 5, 1, "stays here")], [("a", 1, 1, "second part")], [("a", 0, 2, "new text"), ("a", 1, 0, "late"), ("b", 1, 1, None), (None, 0, 1, "no")],
        [("a", 1, 2, None)], [("a", 1, 3, "back again"), ("a", 5, 1, "stays here")],
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = str(tmp_path / "index")
    jobs.index_stream(stream, index, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    want = spark.createDataFrame([("a", 0, "new text"), ("a", 1, "back again"), ("a", 5, "stays here"), ("b", 0, "kept")], "meeting_id string, idx long, text string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(jobs.read_index(spark, index)) == rows(search.build_index(want))
    written = spark.read.parquet(f"{index}/postings")
    assert {(r["batch"], r["meeting_id"], r["idx"]) for r in written.select("batch", "meeting_id", "idx").distinct().collect()} == {(0, "a", 0), (0, "a", 5), (0, "b", 0), (1, "a", 1), (2, "a", 0), (4, "a", 1)}


def test_a_key_that_is_quiet_begins_anew(spark, tmp_path):
    schema = "key string, seq long, value double"
    spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = []

    def once():
        found = jobs.perf_ema_stream(stream(), ttl_ms=1000).writeStream.outputMode("update").foreachBatch(lambda batch, _: got.extend((r["value"], r["samples"]) for r in batch.collect()))
        found.option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination()

    once()
    time.sleep(1.5)
    spark.createDataFrame([("a", 2, 9.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once()
    assert got == [(2.0, 2), (9.0, 1)]
