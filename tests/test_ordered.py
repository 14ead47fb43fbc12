"""Operators that walk the rows of a meeting in order, against plain restatements on whole lists."""

import random

from pyspark.sql import functions as F

from convlake.fixtures import load
from convlake.operators import align
from convlake.sources import exports

WORD = "meeting_id string, n long, text string, start_ms long, end_ms long, speaker string"


def plain_smooth(words):
    """The two rules on a whole list of [text, start, end, speaker]."""
    ends = [(w[0] or "").strip()[-1:] in tuple(".?!…。？！") and bool((w[0] or "").strip()) for w in words]
    who, n = [w[3] for w in words], len(words)
    starts = [i for i in range(n) if i == 0 or who[i] != who[i - 1]]
    for i, after in zip(starts, starts[1:]):
        short = after - i <= 2 and words[after - 1][2] - words[i][1] < 1000
        if i > 0 and short and who[i - 1] == who[after] != who[i] and not ends[i - 1] and not ends[after - 1]:
            who[i:after] = [who[i - 1]] * (after - i)
    for k in range(1, n):
        if who[k] == who[k - 1] or ends[k - 1]:
            continue
        late = [a for a in (k - 1, k - 2) if a > 0 and len(set(who[a:k])) == 1 and ends[a - 1] and not any(ends[a:k])]
        early = [b for b in (k, k + 1) if b < n - 1 and len(set(who[k : b + 1])) == 1 and ends[b] and not any(ends[k:b])]
        if late:
            who[late[0] : k] = [who[k]] * (k - late[0])
        elif early:
            who[k : early[0] + 1] = [who[k - 1]] * (early[0] + 1 - k)
    return who


def test_smooth_speakers(spark):
    rng, rows, want = random.Random(5), [], {}
    for m in range(60):
        at, words = 0, []
        for _ in range(rng.choice([0, 1, 2, 3, 5, 40])):
            at += rng.choice([0, 100, 300])
            words.append([rng.choice([" a", " b.", " c,", " d?", None, ""]), at, at + rng.choice([50, 300, 900]), rng.choice("AAB") if m % 2 else rng.choice("ABC")])
        rows += [(f"m{m}", i, *w) for i, w in enumerate(words)]
        want |= {(f"m{m}", i): s for i, s in enumerate(plain_smooth(words))}
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r["meeting_id"], r["n"]): r["speaker"] for r in align.smooth_speakers(spark.createDataFrame(rows, WORD).repartition(3)).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_switches_follow_earlier_edits(spark):
    rows = [("m", i, " w", i * 100, i * 100 + 90, s) for i, s in enumerate("ABAB")]
    got = [r["speaker"] for r in align.smooth_speakers(spark.createDataFrame(rows, WORD)).orderBy("n").collect()]
    assert got == list("AAAB")


def test_utterances_limits(spark):
    rows = [
        ("m", 0, " One,", 0, 100, "A"), ("m", 1, " two", 1600, 1700, "A"), ("m", 2, " three", 1700, 1800, "B"), ("m", 3, " ", 9000, 9100, "A"),
        ("n", 0, " Long.", 0, 45001, "A"), ("n", 1, " next", 45001, 45100, "A"), ("n", 2, None, 45100, 45200, "A"), ("n", 3, " end", 49201, 49300, "A"),
    ]
    got = [(r["meeting_id"], r["idx"], r["text"]) for r in align.build_utterances(spark.createDataFrame(rows, WORD)).orderBy("meeting_id", "idx").collect()]
    assert got == [("m", 0, "One, two"), ("m", 1, "three"), ("n", 0, "Long."), ("n", 1, "next"), ("n", 2, "end")]


def test_words_are_kept(spark):
    rows = [("m", i, f" w{i}" + "." * (i % 5 == 0), i * 700, i * 700 + 400, "ABC"[i * i % 7 % 3]) for i in range(200)]
    parts = align.build_utterances(align.smooth_speakers(spark.createDataFrame(rows, WORD))).orderBy("idx").collect()
    assert " ".join(p["text"] for p in parts).split() == [r[2].strip() for r in rows]


def test_single_speaker(spark):
    rows = [("a", "S1", "Ann", "named", 5), ("a", "S2", "x", "auto", 1), ("b", "S2", "y", "auto", 2)]
    got = sorted(tuple(r) for r in align.single_speaker(spark.createDataFrame(rows, "meeting_id string, key string, label string, status string, talk_ms long")).collect())
    assert got == [("a", "S1", "Ann", "named"), ("b", "S1", "Speaker 1", "unknown")]


def test_exports_with_notes(spark):
    notes = {
        "summary": "Sum & all", "key_points": ["k"], "decisions": [], "action_items": [{"task": "Do", "owner": "Bo", "due": "Fri", "t": 61, "done": True}, {"task": "Or not", "owner": "", "due": None, "t": None, "done": None}],
        "open_questions": None, "sections": [{"title": "More", "items": ["i", "j"]}], "chapters": [{"t": 5, "title": "Start", "summary": "s"}],
    }
    meetings = spark.createDataFrame([("m", "Plan", 0, 61, notes), ("none", None, 0, 0, None)], f"id string, title string, date_s long, duration_s long, notes {exports.NOTES}")
    segments = spark.createDataFrame([("m", 0, "S1", 1000, 2000, "Hi <b>"), ("m", 1, None, 2000, 3000, None)], "meeting_id string, idx long, speaker string, start_ms long, end_ms long, text string")
    names = spark.createDataFrame([("m", "S1", "Ann")], "meeting_id string, key string, name string")
    made = {fmt: {r[0]: r[1] for r in exports.export_text(segments, names, meetings, fmt).collect()} for fmt in ("txt", "md", "html")}
    assert made["txt"]["m"].split("\n")[4:] == [
        "SUMMARY", "Sum & all", "", "KEY POINTS", "  • k", "", "ACTION ITEMS", "[x] Do (Bo; due Fri) [00:01:01]", "[ ] Or not", "", "MORE", "  • i", "  • j", "",
        "CHAPTERS", "[00:00:05] Start - s", "", "TRANSCRIPT", "-" * 72, "[00:00:01] Ann: Hi <b>", "", "[00:00:02] : ", "",
    ]
    assert "- **00:00:05** Start — s" in made["md"]["m"] and "`00:00:01` **Ann:** Hi <b>" in made["md"]["m"]
    assert "<p>Sum &amp; all</p>" in made["html"]["m"] and "<b>Ann:</b> Hi &lt;b&gt;</p>" in made["html"]["m"]
    assert made["txt"]["none"].startswith("MEETING\n") and "TRANSCRIPT" not in made["txt"]["none"]
    bare = exports.export_text(segments, names, meetings, "txt", notes=False, timestamps=False).where("meeting_id = 'm'").first()[1]
    assert "SUMMARY" not in bare and "\nAnn: Hi <b>\n" in bare


def test_align_meetings_with_and_without_turns(spark):
    words = [(m, 0, i, w, i * 500, i * 500 + 400) for m in "ab" for i, w in enumerate([" One", " two.", " Three", " four."])]
    turns = spark.createDataFrame([("a", "S2", 0, 950), ("a", "S1", 950, 2000)], "meeting_id string, speaker string, start_ms long, end_ms long")
    got = align.align(spark.createDataFrame(words, "meeting_id string, idx long, pos long, text string, start_ms long, end_ms long"), turns).orderBy("meeting_id", "idx").collect()
    assert [(r["meeting_id"], r["idx"], r["speaker"], r["text"]) for r in got] == [("a", 0, "S2", "One two."), ("a", 1, "S1", "Three four."), ("b", 0, "S1", "One two. Three four.")]


def test_a_long_meeting_in_chunks_of_any_size(spark):
    rng, rows, at = random.Random(11), [], 0
    for m in ("long", "monologue"):
        n = 0
        while n < 2500:
            speaker = rng.choice("AABC") if m == "long" else "A"
            for _ in range(rng.choice([1, 1, 2, 2, 3, 6, 30, 70])):
                at += rng.choice([0, 100, 300, 300, 1700]) + (rng.random() < 0.01) * 5000
                rows.append((m, n, rng.choice([" a", " b.", " c,", " d?", " e", " f", None]), at, at + rng.choice([50, 300, 900]), speaker))
                n += 1
    words = spark.createDataFrame(rows, WORD).repartition(3)
    smooth = {m: plain_smooth([list(r[2:]) for r in rows if r[0] == m]) for m in ("long", "monologue")}
    want = {(m, i): s for m, speakers in smooth.items() for i, s in enumerate(speakers)}
    utterances = None
    for size in (1, 50, 333, 5000):
        done = align.smooth_speakers(words, size)
        assert {(r["meeting_id"], r["n"]): r["speaker"] for r in done.collect()} == want
        found = sorted(tuple(r) for r in align.build_utterances(done, size).collect())
        utterances = utterances or found
        assert found == utterances
    cut = align._chunks(words.withColumn("r", F.expr(f"row_number() OVER ({align.ORDER})")), "n % 2 = 0", 50).groupBy("meeting_id", "chunk").count()
    assert cut.count() > 90


def test_meetings_of_one_chunk_and_of_many_align_alike(spark):
    words, turns = (load(spark, "/root/testdata/sf0.001", name) for name in ("words_fx", "turns_fx"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = rows(align.align(words, turns))
    assert rows(align.align(words, turns, size=50)) == want and len(want) > 50
