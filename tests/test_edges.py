"""Conversation queries on empty tables, and on rows with nulls and extra columns."""

import pytest

from convlake.operators import notes, search, speakers, stats
from convlake.plans import conversations, library, retrieval, sources, transcripts, voices  # noqa: F401
from convlake.plans import notes as note_plans  # noqa: F401

TABLES = "events documents embeddings pages conversations".split()


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{where}/{t}.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(conversations.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert conversations.QUERIES[name](spark, nothing).collect() == []


def test_speaker_at_nulls(spark):
    segments = spark.createDataFrame([("m", 0, 0, 1000, "S1"), ("m", 1, 2000, 3000, None)], "meeting_id string, idx long, start_ms long, end_ms long, speaker string")
    times = spark.createDataFrame([("m", 1000), ("m", 1600), ("m", 1400), ("m", 3500), ("m", 3501), ("other", 1)], "meeting_id string, at_ms long")
    got = {(r[0], r[1]): r[2] for r in stats.speaker_at(segments, times).collect()}
    assert got == {("m", 1000): "S1", ("m", 1400): None, ("m", 1600): None, ("m", 3500): None, ("m", 3501): None, ("other", 1): None}


def test_clean_actions_edges(spark):
    rows = [
        ("m", 0, " Send it. ", "n/a", " Ann ", "0:10", 60), ("m", 1, "send IT", "Bo", None, None, 60), ("m", 2, None, "Bo", "", "", 60),
        ("m", 3, "  ", "Bo", "", "", 60), ("m", 4, "日本", None, "TBD", "2:00", 60), ("m", 5, "中文", "", "", "", 60),
    ]
    got = notes.clean_actions(spark.createDataFrame(rows, "meeting_id string, idx long, task string, owner string, due string, time string, duration_s long")).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [("m", 0, "Send it.", "", "Ann", 10, False), ("m", 4, "日本", "", "", None, False)]


def test_recent_chat_keeps_other_columns(spark):
    chat = spark.createDataFrame([("m", i, None, "x") for i in range(5)], "meeting_id string, id long, content string, extra string")
    got = search.recent_chat(chat, 3).orderBy("n").collect()
    assert [(r["id"], r["n"], r["content"], r["extra"]) for r in got] == [(2, 1, None, "x"), (3, 2, None, "x"), (4, 3, None, "x")]


def test_voiceprints_short_turns_and_nulls(spark):
    rows = [("m", "S1", 0, 1000, [3.0, 4.0]), ("m", "S1", 5000, 5500, None), ("m", "S2", 0, 2000, [1.0, 0.0]), ("m", "S2", 9000, 9100, [0.0, 1.0])]
    got = {r[1]: [round(x, 6) for x in r[2]] for r in speakers.voiceprints(spark.createDataFrame(rows, "meeting_id string, key string, start_ms long, end_ms long, embedding array<double>")).collect()}
    assert got == {"S1": [0.6, 0.8], "S2": [1.0, 0.0]}


def test_rename_speakers_clashes(spark):
    people = spark.createDataFrame([(1, "Ann"), (2, "Bo"), (3, None)], "id long, name string")
    changes = spark.createDataFrame([(1, "bo"), (2, "BO "), (3, "Cy"), (1, "cy"), (2, None), (3, " ")], "id long, name string")
    got = {(r["id"], r["name"]): r["accepted"] for r in speakers.rename_speakers(people, changes).collect()}
    assert got == {(1, "bo"): False, (2, "BO"): True, (3, "Cy"): False, (1, "cy"): True}
