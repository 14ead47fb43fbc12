"""Files read and written, answers parsed, and the streams that feed tables."""

import json

from convlake.operators import notes, search
from convlake.sources import tables


def test_transcripts_and_turns(spark, tmp_path):
    doc = {"meeting_id": "m", "segments": [{"start": 0, "end": 2, "text": " hi you", "words": [[0.12, 0.4, " hi", 0.98], [0.5, 0.9, " you", 0.5]]}, {"start": 2.5, "end": 3, "text": " all", "words": []}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    got = [tuple(r) for r in tables.read_transcripts(spark, str(tmp_path / "t.json")).orderBy("idx", "pos").collect()]
    assert got == [("m", 0, 0, " hi", 120, 400, 0.98), ("m", 0, 1, " you", 500, 900, 0.5), ("m", 1, 0, " all", 2500, 3000, 1.0)]
    (tmp_path / "u.json").write_text(json.dumps({"meeting_id": "m", "order": ["S2"], "turns": [{"start": 0, "end": 1.5, "speaker": 0}, {"start": 2, "end": 3, "speaker": 4}]}))
    assert sorted(tuple(r) for r in tables.read_turns(spark, str(tmp_path / "u.json")).collect()) == [("m", "S2", 0, 1500), ("m", "S5", 2000, 3000)]


def test_write_by_meeting(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "meeting_id string, x long")
    held = lambda **k: sorted((r["meeting_id"], r["x"]) for r in tables.read_by_meeting(spark, path, rows.schema, **k).collect())
    assert held() == []
    tables.write_by_meeting(rows, path, 2)
    before = tables.read_by_meeting(spark, path, rows.schema)
    tables.write_by_meeting(spark.createDataFrame([("a", 9), ("d", 5)], rows.schema), path)
    tables.write_by_meeting(rows.limit(0), path)
    assert held() == [("a", 9), ("b", 3), ("c", 4), ("d", 5)] and held(meetings=["a", "zz"]) == [("a", 9)]
    assert before.count() == 4  # who read before the change still sees what was
    # A writer that died: rows without a state, and a state that was not finished.
    spark.createDataFrame([("a", 0, 0)], "meeting_id string, x long, bucket int").write.partitionBy("bucket").parquet(f"{path}/rows/2")
    (tmp_path / "t" / "states" / "2").mkdir()
    assert held() == [("a", 9), ("b", 3), ("c", 4), ("d", 5)]
    (tmp_path / "t" / "states" / "2").rmdir()
    tables.write_by_meeting(spark.createDataFrame([("a", 8)], rows.schema), path)
    assert held() == [("a", 8), ("b", 3), ("c", 4), ("d", 5)]
    tables.clear_states(spark, path, 1)
    assert held() == [("a", 8), ("b", 3), ("c", 4), ("d", 5)] and [p.name for p in (tmp_path / "t" / "states").iterdir()] == ["2"]


def test_codec_nulls(spark):
    rows = spark.createDataFrame([(bytearray(b"\x00\x00\x80?"),), (bytearray(b"abc"),), (None,), (bytearray(),)], "b binary")
    assert [r[0] for r in rows.select(tables.decode_embedding("b")).collect()] == [[1.0], None, None, []]


def test_parse_answers(spark):
    texts = [
        '{"a": "x", "b": ["1"]}', '<think>hm {</think>```json\n{"a": "y"}\n```', 'Here: {"a": "z", "b": ["1",],} done', '{"a": "cut", "b": ["1", "2", "thr', '{"a": "q\\"', "no object", None, "", "<think>only", '{"a": "deep", "c": {"d": [1, {"e": 2',
    ]
    got = {r["text"]: (r["outcome"], r["answer"] and (r["answer"]["a"], r["answer"]["b"])) for r in notes.parse_answers(spark.createDataFrame([(t,) for t in texts], "text string"), "struct<a:string,b:array<string>>").collect()}
    assert [got[t] for t in texts] == [
        ("ok", ("x", ["1"])), ("ok", ("y", None)), ("ok", ("z", ["1"])), ("repaired", ("cut", ["1", "2"])), ("bad", None), ("bad", None), ("bad", None), ("bad", None), ("bad", None), ("repaired", ("deep", None)),
    ]


def test_map_parts_and_condense(spark):
    parts = spark.createDataFrame([("m", i, str(i), None if i == 2 else f"p{i}") for i in range(5)], "meeting_id string, part long, key string, prompt string")
    got = {r["part"]: r["answer"] for r in notes.map_parts(parts, lambda asked: [p.upper() for p in asked], 3).collect()}
    assert got == {0: "P0", 1: "P1", 2: None, 3: "P3", 4: "P4"}
    sizes = {"fits": [10, 20], "packs": [30, 30, 30, 50, 10], "pairs": [90, 90, 90], "one": [500]}
    rows = spark.createDataFrame([(m, i, n) for m, ns in sizes.items() for i, n in enumerate(ns)], "meeting_id string, part long, tokens long")
    got = {}
    for r in notes.condense_groups(rows, 100).orderBy("part").collect():
        got.setdefault(r["meeting_id"], []).append(r["group"])
    assert got == {"packs": [0, 0, 1, 1, 2], "pairs": [0, 0, 1]}


def test_phrases_in_the_index(spark):
    rows = spark.createDataFrame([("m", 0, "L'été d'or"), ("m", 1, "l ete"), ("m", 2, "ete l"), ("m", 3, None)], "meeting_id string, idx long, text string")
    index, about = search.build_index(rows), search.index_statistics(rows)
    assert {r["idx"] for r in search.search_index(index, about, "l'ét").collect()} == {0, 1}
    assert {r["idx"] for r in search.search_index(index, about, "ete l").collect()} == {0, 1, 2}
    assert search.search_index(index, about, " ?").collect() == [] and search.search_index(index, about, "zz").collect() == []
