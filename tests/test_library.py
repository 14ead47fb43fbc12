"""Edits, decisions and renames on rows with nulls, ties and odd names."""

from convlake.operators import align, diarize, meetings, notes, recordings, search, stats


def test_rename_takes_names_letter_by_letter(spark):
    texts = spark.createDataFrame([("m", "A.B and AxB, A.B.", None), ("n", "A.B", "x"), ("o", None, "")], "meeting_id string, summary string, title string")
    renames = spark.createDataFrame([("m", "A.B", "C$1\\"), ("m", "", "no"), ("m", None, "no"), ("o", "A.B", "C")], "meeting_id string, old string, new string")
    got = {r["meeting_id"]: (r["summary"], r["title"]) for r in notes.rename_in_notes(texts, renames, ["summary", "title"]).collect()}
    assert got == {"m": ("C$1\\ and AxB, C$1\\.", None), "n": ("A.B", "x"), "o": (None, "")}


def test_delete_meetings(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "meeting_id string, x long")
    left = meetings.delete_meetings(spark.createDataFrame([("a",)], "meeting_id string"), chat=rows, segments=rows)
    assert {k: sorted(r["x"] for r in v.collect()) for k, v in left.items()} == {"chat": [2, 3], "segments": [2, 3]}


def test_longest_run_is_from_first_start_to_last_end(spark):
    rows = [("m", 0, "S1", "a b", 0, 10000), ("m", 1, "S1", "c", 3000, 4000), ("m", 2, "S2", "d", 4000, 5000)]
    got = stats.speaker_stats(spark.createDataFrame(rows, "meeting_id string, idx long, speaker string, text string, start_ms long, end_ms long"))
    assert {(r["speaker"], r["longest_ms"], r["talk_ms"]) for r in got.collect()} == {("S1", 4000, 11000), ("S2", 1000, 1000)}


def test_turns_in_seconds(spark):
    frames = [("m", "a", f) for f in [*range(0, 8), *range(13, 20)]] + [("m", "b", f) for f in range(100, 105)]
    got = [tuple(r)[1:] for r in diarize.frames_to_turns(spark.createDataFrame(frames, "meeting_id string, speaker string, frame long")).collect()]
    at = lambda f: round(max(0.0, f * 270 / 16000 + 991 / 32000 - 270 / 32000), 3)
    assert got == [("a", 0, 19, at(0), at(20))]


def test_talk_time_of_meetings_without_turns(spark):
    segments = spark.createDataFrame([("m", "S1", 0, 5000), ("m", "S2", 5000, 6000), ("n", "S1", 0, 700), ("n", "S2", 700, 800)], "meeting_id string, speaker string, start_ms long, end_ms long")
    known = spark.createDataFrame([("m", "S1", "One", "auto", 9), ("n", "S1", "One", "auto", 9)], "meeting_id string, key string, label string, status string, talk_ms long")
    got = align.rebuild_segments(segments, known, spark.createDataFrame([("n",)], "meeting_id string")).collect()
    assert {tuple(r) for r in got} == {("m", "S1", "One", "auto", 6000), ("m", "S2", "Speaker 2", "unknown", 0), ("n", "S1", "One", "auto", 9), ("n", "S2", "Speaker 2", "unknown", 0)}


def test_meeting_edits_and_vocabulary(spark):
    known = spark.createDataFrame([("m", "T", False, ["x"], False), ("n", "T", True, ["x"], True)], "id string, title string, favorite boolean, tags array<string>, locked boolean")
    edits = [("m", 1, "\t New\n", None, None), ("m", 2, " ", True, [" a ", "", "b" * 50] + ["c"] * 30), ("m", 3, None, None, None)]
    got = {r["id"]: tuple(r)[1:] for r in meetings.apply_meeting_edits(known, spark.createDataFrame(edits, "id string, seq long, title string, favorite boolean, tags array<string>")).collect()}
    assert got == {"m": ("New", True, [" a ", "", "b" * 40] + ["c"] * 17, True), "n": ("T", True, ["x"], True)}
    people = spark.createDataFrame([(1, "Ann", 5), (2, "c", 9)], "id long, name string, updated long")
    words = meetings.vocabulary(spark.createDataFrame([("m", " a;\tc \n,B,,a ")], "meeting_id string, vocabulary string"), people)
    assert words.first()["words"] == "a, c, B, Ann"


def test_recordings_of_any_size_in_linear_time(spark):
    chunks = spark.range(100_000).selectExpr("if(id % 10 = 0, 'b', 'a') AS rid", "id AS seq", "cast(concat(id, ';') AS binary) AS bytes").unionByName(spark.createDataFrame([("c", 1, b"short"), ("d", 1, None)], "rid string, seq long, bytes binary"))
    rows = recordings.assemble(chunks.repartition(7), 10, 50_000).collect()
    want = {"a": "".join(f"{k};" for k in range(100_000) if k % 10), "b": "".join(f"{k};" for k in range(0, 100_000, 10))}
    got = {r: b"".join(bytes(x["bytes"]) for x in sorted(rows, key=lambda x: x["part"]) if x["rid"] == r).decode() for r in {x["rid"] for x in rows}}
    assert got == want and max(len(x["bytes"]) for x in rows) < 50_010


def test_a_search_reads_its_tokens_once(spark, tmp_path):
    segments = spark.createDataFrame([("m", k, f"word{k % 7} other") for k in range(50)], "meeting_id string, idx long, text string")
    search.build_index(segments).write.parquet(str(tmp_path / "postings"))
    search.index_statistics(segments).write.parquet(str(tmp_path / "about"))
    postings, about = (spark.read.parquet(str(tmp_path / n)) for n in ("postings", "about"))
    found = search.search_index(postings, about, "other word3")
    assert found.count() == 7
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found._jdf.queryExecution().executedPlan().toString().count("StringStartsWith(token,word3)") >= 1 and "words" in plan
