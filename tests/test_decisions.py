"""Decisions and corrections one after another, case by case."""

import pytest

from convlake.operators import decisions

MS = "meeting_id string, key string, label string, color string, speaker_id long, status string, suggested_id long, talk_ms long"
TOLD = "meeting_id string, seq long, key string, action string, speaker_id long, name string, learn boolean, target string"
PEOPLE = [(1, "Ann", "#a"), (2, "Bob", "#b"), (7, "Cid", "#c")]


def decide(spark, rows, told, people=PEOPLE):
    made = decisions.apply_decisions(spark.createDataFrame(rows, MS), spark.createDataFrame(told, TOLD), spark.createDataFrame(people, "id long, name string, color string"))
    return {k: sorted((tuple(r) for r in v.collect()), key=repr) for k, v in made.items()}


def test_each_action(spark):
    rows = [(m, "S2", "Some", "#x", 1, s, 2, 5) for m, s in (("auto", "auto"), ("sure", "confirmed"), ("off", "confirmed"), ("yes", "suggested"))] + [("none", "S3", "L", "#x", None, "unknown", None, 0)]
    told = [(m, 1, "S2", a, None, None, None, None) for m, a in (("auto", "reject"), ("sure", "reject"), ("off", "unlink"), ("yes", "confirm"))]
    told += [("none", 1, "S3", "confirm", None, None, None, None), ("none", 2, "S3", "assign", None, " ", None, None), ("none", 3, "S3", "assign", 99, None, None, None), ("none", 4, "S9", "reject", None, None, None, None), (None, 1, "S1", "reject", None, None, None, None)]
    got = decide(spark, rows, told)
    assert got["speakers"] == sorted([
        ("auto", "S2", "Speaker 2", "#x", None, "unknown", None, 5), ("sure", "S2", "Some", "#x", 1, "unknown", None, 5),
        ("off", "S2", "Speaker 2", "#x", None, "unknown", 2, 5), ("yes", "S2", "Ann", "#a", 1, "confirmed", None, 5), ("none", "S3", "L", "#x", None, "unknown", None, 0),
    ], key=repr)
    assert got["moved"] == [] and got["learn"] == [("yes", 1, "S2", 1)]
    assert got["names"] == [("auto", 1, "Ann", "Speaker 2"), ("off", 1, "Ann", "Speaker 2")]


def test_a_person_linked_twice_merges_into_the_later_key(spark):
    rows = [("m", "S1", "Speaker 1", "#x", None, "unknown", None, 10), ("m", "S2", "Speaker 2", "#y", 7, "auto", None, 20), ("m", "S10", "Speaker 10", "#z", None, "suggested", 7, 40)]
    told = [("m", 2, "S10", "confirm", None, None, None, None), ("m", 3, "S1", "assign", 7, None, False, None), ("m", 4, "S2", "assign", 1, None, None, None)]
    got = decide(spark, rows, told)
    assert got["speakers"] == [("m", "S1", "Cid", "#c", 7, "confirmed", None, 70)]
    assert got["moved"] == [("m", "S10", "S1"), ("m", "S2", "S1")]
    assert got["learn"] == [("m", 2, "S10", 7)]


def test_names_find_or_make_people(spark):
    rows = [(m, k, "L", "#x", None, "unknown", None, 1) for m in ("a", "b") for k in ("S1", "S2", "S3")]
    told = [("a", 1, "S1", None, None, "\tann ", None, None), ("b", 1, "S1", "assign", None, "Dee", False, None), ("a", 2, "S2", "assign", None, "Dee", True, None), ("b", 3, "S2", "assign", None, "dEE ", False, None), ("b", 2, "S9", "assign", None, "Nobody", True, None)]
    got = decide(spark, rows, told)
    by = {r[:2]: r[2:6] for r in got["speakers"]}
    color = decisions.PALETTE[7]
    assert by["a", "S1"] == ("Ann", "#a", 1, "confirmed") and by["b", "S1"] == ("Dee", "#x", None, "named")
    assert by["a", "S2"] == by["b", "S2"] == ("Dee", color, 8, "confirmed")
    assert (8, "Dee", color) in got["people"] and len(got["people"]) == 4
    assert got["learn"] == [("a", 1, "S1", 1), ("a", 2, "S2", 8)]


def test_merges_follow_one_another_and_empty_tables(spark):
    rows = [("m", k, k, "#x", None, "unknown", None, 1) for k in ("S1", "S2", "S3")]
    told = [("m", 1, "S1", "merge", None, None, None, "S2"), ("m", 2, "S2", "merge", None, None, None, "S3"), ("m", 3, "S1", "assign", 1, None, None, None), ("m", 4, "S3", "merge", None, None, None, "S3")]
    got = decide(spark, rows, told)
    assert got["speakers"] == [("m", "S3", "S3", "#x", None, "unknown", None, 3)] and got["moved"] == [("m", "S1", "S3"), ("m", "S2", "S3")]
    assert decide(spark, rows, [])["moved"] == [] and decide(spark, [], told, [])["speakers"] == []


def test_confirm_all(spark):
    rows = [("m", "S1", "L", "#x", 1, "auto", None, 1), ("m", "S2", "L", "#x", None, "suggested", 1, 2), ("m", "S3", "L", "#x", 2, "unknown", 7, 4), ("n", "S1", "L", "#x", 1, "auto", None, 1)]
    got = decisions.confirm_all(spark.createDataFrame(rows, MS), spark.createDataFrame([("m",)], "meeting_id string"), spark.createDataFrame(PEOPLE, "id long, name string, color string"))
    assert {tuple(r)[:6] for r in got["speakers"].collect()} == {("m", "S2", "Ann", "#a", 1, "confirmed"), ("m", "S3", "L", "#x", 2, "unknown"), ("n", "S1", "L", "#x", 1, "auto")}


SEG = "meeting_id string, idx long, speaker string, text string, start_ms long, end_ms long, edited boolean"
EDIT = "meeting_id string, idx long, seq long, text string, speaker string, learn boolean"


@pytest.fixture(scope="module")
def edited(spark):
    segments = [("m", 0, "S1", "a", 0, 20000, None), ("m", 1, "S2", "b", 20000, 21000, True), ("m", 2, None, None, 21000, 22000, False), ("m", 3, "S1", "same", 22000, 23000, False)]
    edits = [
        ("m", 0, 1, "x", "S2", True), ("m", 0, 2, " ", "new", True), ("m", 1, 3, "\tB ", "S88", None), ("m", 2, 4, None, "S1", None), ("m", 3, 5, "same", "S1", True), ("m", 9, 6, "lost", "new", None),
        ("m", 2, 7, None, "new", None), ("m", 2, 8, None, "S6", True), ("n", 0, 1, "x", "S1", None),
    ]
    speakers = [("m", "S1", "One", "#8b5cf6", 1, "auto", None, 15000), ("m", "S2", "Two", "#f59e0b", 2, "auto", None, 3000), ("m", "S4", "Silent", "#y", None, "unknown", None, 0)]
    return {k: v.collect() for k, v in decisions.apply_segment_edits(spark.createDataFrame(segments, SEG), spark.createDataFrame(edits, EDIT), spark.createDataFrame(speakers, MS)).items()}


def test_segment_edits_in_order(edited):
    got = {r["idx"]: (r["speaker"], r["text"], r["edited"]) for r in edited["segments"]}
    assert got == {0: ("S5", "x", True), 1: ("S2", "B", True), 2: ("S6", None, True), 3: ("S1", "same", True)}


def test_talk_time_is_floored_step_by_step(edited):
    got = {r["key"]: (r["talk_ms"], r["label"], r["color"]) for r in edited["speakers"]}
    # 15000 - 20000 gives 0, + 1000, then - 1000 and + 1000 of a segment that stays, - 1000; S2: + 20000 - 20000.
    assert got == {"S1": (0, "One", "#8b5cf6"), "S2": (3000, "Two", "#f59e0b"), "S4": (0, "Silent", "#y"), "S5": (20000, "Speaker 5", "#06b6d4"), "S6": (1000, "Speaker 6", "#ec4899")}


def test_clips_only_where_learning_is_asked_of_a_person(edited):
    assert [(r["idx"], r["seq"], r["speaker_id"], r["start_ms"], r["end_ms"]) for r in edited["clips"]] == [(0, 1, 2, 0, 12000)]
