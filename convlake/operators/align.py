"""Words and speaker turns: flattening, overlap, nearest turn, filling (T)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.ordered import in_order
from convlake.functions.written import written

LOOK_BACK = 12
NEAR_MS = 2000
LEAST_WORD_MS = 20


def flatten_words(words: DataFrame) -> DataFrame:
    """T1. Words of a meeting in order of start, ties as they stood; a word never ends before it starts."""
    rows = words.selectExpr("meeting_id", "idx", "pos", "text", "start_ms", "greatest(start_ms, end_ms) AS end_ms")
    return rows.selectExpr("meeting_id", "cast(row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, idx, pos) AS bigint) AS n", "text", "start_ms", "end_ms")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Turns of a meeting with their number k in order of start, as (ts, te)."""
    return turns.selectExpr("meeting_id", "speaker", "start_ms AS ts", "end_ms AS te", "cast(row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, speaker) AS bigint) AS k")


def _with_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words with the `speaker` of T2. Each turn carries the turns around it, and a word takes those of the last turn that
    begins by its end: words and turns of a meeting are sorted once, and no word meets a turn in a join."""
    around = f"collect_list(struct(k, ts, te, speaker)) OVER (PARTITION BY meeting_id ORDER BY k ROWS BETWEEN {LOOK_BACK - 1} PRECEDING AND 1 FOLLOWING)"
    known = numbered_turns(turns).selectExpr("meeting_id", "ts AS at", "k", f"{around} AS around", "struct(k, ts, te, speaker) AS turn")
    ends = F.expr(f"greatest(end_ms, start_ms + {LEAST_WORD_MS})")
    rows = words.select("meeting_id", ends.alias("at"), "start_ms", F.struct(*words.columns).alias("word"))
    met = rows.unionByName(known, allowMissingColumns=True)
    before = "OVER (PARTITION BY meeting_id ORDER BY at, k NULLS LAST ROWS UNBOUNDED PRECEDING)"
    first = "min(if(k = 1, turn, NULL)) OVER (PARTITION BY meeting_id)"
    met = met.selectExpr("word", "at AS we", "start_ms", f"coalesce(last_value(k) IGNORE NULLS {before}, 0L) AS i", f"coalesce(last_value(around) IGNORE NULLS {before}, array({first})) AS around")
    met = met.where("word IS NOT NULL").selectExpr("word", "we", "start_ms", "i", "filter(around, t -> t IS NOT NULL) AS around", "(start_ms + we) / 2D AS middle")
    over = "transform(filter(around, t -> t.k <= i), t -> struct(least(we, t.te) - greatest(start_ms, t.ts) AS overlap, t.k AS k, t.speaker AS speaker))"
    near = "transform(filter(around, t -> t.k >= i AND t.speaker IS NOT NULL), t -> struct(if(t.k = i, abs(middle - t.te), abs(t.ts - middle)) AS distance, t.speaker AS speaker))"
    speaker = f"coalesce(array_max(filter({over}, t -> t.overlap > 0)).speaker, array_min(filter({near}, t -> t.distance < {NEAR_MS})).speaker) AS speaker"
    return met.selectExpr("word.*", speaker)


def assign_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """T2 and T3. Per word the turn it overlaps most, of the last twelve that begin by its end (the later on
    ties); else the nearer of the turns around it if under two seconds from its middle (the smaller
    speaker on ties); else null. Turns are met by number, never by a comparison of times."""
    return _with_speakers(words.select("meeting_id", "n", "start_ms", "end_ms"), turns).select("meeting_id", "n", "speaker")


def _filled(assigned: DataFrame) -> DataFrame:
    before = "last_value(speaker) IGNORE NULLS OVER (PARTITION BY meeting_id ORDER BY n ROWS UNBOUNDED PRECEDING)"
    first = "(min(if(speaker IS NULL, NULL, struct(n, speaker))) OVER (PARTITION BY meeting_id)).speaker"
    return assigned.withColumn("speaker", F.expr(f"coalesce({before}, {first})"))


def fill_gaps(assigned: DataFrame) -> DataFrame:
    """T4. Unknown speakers take the one before, else the one after, which is the meeting's first."""
    return _filled(assigned).select("meeting_id", "n", "speaker")


# What ends a sentence, and the limits of utterances and cues.
SENTENCE_END = tuple(".?!…。？！")
SHORT_WORDS, SHORT_MS = 2, 1000
PAUSE_MS, LONG_PAUSE_MS, LONG_MS = 1500, 4000, 45000
CUE_MS, CUE_CHARS = 6000, 84


def _undo_switches(rows: Iterator[tuple]) -> Iterator[list]:
    """Runs of one or two words under a second inside a sentence go to the speaker around them. Rows are
    (meeting_id, n, text, start_ms, end_ms, speaker); what comes out is [row, ends a sentence, speaker]."""
    source = ([r, (r[2] or "").strip().endswith(SENTENCE_END), r[5]] for r in rows)
    ahead: deque = deque(islice(source, SHORT_WORDS + 1))
    before = None
    while ahead:
        own = ahead[0][2]
        run = next((k for k, w in enumerate(ahead) if w[2] != own), len(ahead))
        if run <= SHORT_WORDS and run < len(ahead) and before is not None and own != before[2] == ahead[run][2]:
            last = ahead[run - 1]
            if last[0][4] - ahead[0][0][3] < SHORT_MS and not before[1] and not last[1]:
                for k in range(run):
                    ahead[k][2] = before[2]
        # A run that is longer than what is seen ahead is passed on until the speaker changes.
        left = run
        while ahead and (left > 0 or ahead[0][2] == own == before[2]):
            before = ahead.popleft()
            left -= 1
            yield list(before)
            ahead.extend(islice(source, 1))


# Where a change of speaker lies beside the end of a sentence, by place from the first word of the new speaker: the word that ends
# the sentence, a word that must follow, the words that change hands, and the word whose speaker they get. The first that fits counts.
SNAPS = [(-2, 0, (-1,), 0), (-3, 0, (-2, -1), 0), (0, 1, (0,), -1), (1, 2, (0, 1), -1)]
BEHIND = 3


def _snap_changes(words: Iterator[list]) -> Iterator[list]:
    """Changes of speaker one or two words off the end of a sentence move there; six words around each are held."""
    around: deque = deque([None] * BEHIND + list(islice(words, BEHIND)))
    around.extend([None] * (2 * BEHIND - len(around)))
    while (now := around[BEHIND]) is not None:
        before = around[BEHIND - 1]
        if before is not None and before[2] != now[2] and not before[1]:
            for end, follows, moved, giver in SNAPS:
                last, own = around[BEHIND + end], [around[BEHIND + m] for m in moved]
                if last is not None and last[1] and around[BEHIND + follows] is not None and len({w[2] for w in own}) == 1:
                    speaker = around[BEHIND + giver][2]
                    for w in own:
                        w[2] = speaker
                    break
        if (done := around.popleft()) is not None:
            yield done
        around.append(next(words, None))
    yield from (w for w in around if w is not None)


CHUNK_WORDS, AROUND = 4096, 8
ORDER = "PARTITION BY meeting_id ORDER BY n, start_ms"


def _chunks(words: DataFrame, cut: str, size: int) -> DataFrame:
    """Words, with their place r in the meeting, and a `chunk`: a new one begins at the first word of each `size` words where `cut` holds,
    not in the last 2 * AROUND of them, so that two borders lie as far apart."""
    rows = words.selectExpr("*", f"coalesce({cut}, false) AS cut")
    rows = rows.withColumn("cut", F.expr(f"cut AND r >= {size} AND r % {size} < {max(1, size - 2 * AROUND)}"))
    # All windows have one order, so the words of a meeting are sorted once.
    last = f"max(if(cut, r div {size}, 0)) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = rows.withColumn("border", F.expr(f"cut AND coalesce({last}, 0) < r div {size}"))
    return rows.withColumn("chunk", F.expr(f"count_if(border) OVER ({ORDER} ROWS UNBOUNDED PRECEDING)"))


def _smoothed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows are (meeting_id, chunk, r, n, text, start_ms, end_ms, speaker, own, ..)."""
    words = ((m, n, text, start, end, speaker, own) for m, _, _, n, text, start, end, speaker, own, *_ in rows)
    for row, _, speaker in _snap_changes(_undo_switches(words)):
        if row[6]:
            yield *row[:5], speaker


WORDS_SCHEMA = "n long, text string, start_ms long, end_ms long, speaker string"


def _overlapping(words: DataFrame, size: int) -> DataFrame:
    """Words by chunk (meeting_id, chunk, r, n, text, start_ms, end_ms, speaker, own, whole), with those of its neighbours that a chunk sees (not
    its own). `whole` tells that the meeting is one chunk."""
    rows = words.select("meeting_id", "n", "text", "start_ms", "end_ms", "speaker")
    rows = rows.selectExpr("*", f"row_number() OVER ({ORDER}) AS r", f"NOT speaker <=> lag(speaker) OVER ({ORDER}) AS change")
    rows = rows.withColumn("run", F.expr(f"max(if(change, r, 0)) OVER ({ORDER} ROWS UNBOUNDED PRECEDING)"))
    same = f"speaker IS NOT NULL AND r - run >= {AROUND} AND lead(run, {AROUND - 1}) OVER ({ORDER}) = run"
    rows = _chunks(rows, same, max(size, 3 * AROUND))
    ahead = f"if(lead(chunk, {AROUND}) OVER ({ORDER}) > chunk, chunk + 1, NULL)"
    behind = f"if(lag(chunk, {AROUND}) OVER ({ORDER}) < chunk, chunk - 1, NULL)"
    seen = f"filter(array(struct(chunk AS c, true AS own), struct({ahead} AS c, false AS own), struct({behind} AS c, false AS own)), x -> x.c IS NOT NULL)"
    rows = rows.selectExpr("*", f"{seen} AS seen", "NOT bool_or(border) OVER (PARTITION BY meeting_id) AS whole")
    rows = rows.selectExpr("meeting_id", "r", "n", "text", "start_ms", "end_ms", "speaker", "whole", "explode(seen) AS x")
    return rows.selectExpr("meeting_id", "x.c AS chunk", "r", "n", "text", "start_ms", "end_ms", "speaker", "x.own AS own", "whole")


def smooth_speakers(words: DataFrame, size: int = CHUNK_WORDS) -> DataFrame:
    """T5. Words (meeting_id, n, text, start_ms, end_ms, speaker) without switches of one or two words inside a
    sentence, and with changes that are one or two words off the end of a sentence moved there. Later decisions see
    earlier ones. A null text ends no sentence; words of a meeting that repeat an n are taken by start.

    A long meeting is cut into chunks of about `size` words, each a task's work: inside runs of 16 words of one speaker, across which no
    decision is felt, as switches have two words and changes move by two. Chunks see 8 words of their neighbours. Without such a run a
    chunk goes on."""
    kind = words.schema["meeting_id"].dataType.simpleString()
    return in_order(_overlapping(words, size), ["meeting_id", "chunk"], ["r"], _smoothed, f"meeting_id {kind}, {WORDS_SCHEMA}")


def _utterances(rows: Iterator[tuple]) -> Iterator[tuple]:
    number, start, until, speaker, text = 0, 0, 0, None, ""
    for meeting, chunk, _, *row in rows:
        n, word, begins, ends, who = row
        pause = begins - until
        new = number == 0 or who != speaker or pause > LONG_PAUSE_MS
        new = new or pause > PAUSE_MS and text.endswith((*SENTENCE_END, ",")) or until - start > LONG_MS and text.endswith(SENTENCE_END)
        if new:
            number, start, until, speaker = number + 1, begins, ends, who
        until, text = max(until, ends), (word or "").strip()
        yield meeting, *row, chunk, number


def _smoothed_and_numbered(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Smoothed words, with utterances where the chunk is a whole meeting."""
    first = next(rows)
    smooth = _smoothed(chain([first], rows))
    if first[9]:
        return _utterances((row[0], 0, 0, *row[1:]) for row in smooth)
    return ((*row, None, None) for row in smooth)


def _numbered(words: DataFrame, size: int) -> DataFrame:
    """Words with their utterance, as chunk and number in it. Where the speaker changes, or all that was said before is over for 4 s, a
    new utterance begins whatever came before: there chunks of about `size` words are cut."""
    kind = words.schema["meeting_id"].dataType.simpleString()
    rows = words.select("meeting_id", "n", "text", "start_ms", "end_ms", "speaker")
    cut = f"NOT speaker <=> lag(speaker) OVER ({ORDER}) OR start_ms - max(end_ms) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {LONG_PAUSE_MS}"
    rows = rows.withColumn("r", F.expr(f"row_number() OVER ({ORDER})"))
    rows = _chunks(rows, cut, max(size, 3 * AROUND)).select("meeting_id", "chunk", "r", "n", "text", "start_ms", "end_ms", "speaker")
    return in_order(rows, ["meeting_id", "chunk"], ["r"], _utterances, f"meeting_id {kind}, {WORDS_SCHEMA}, chunk long, utterance long")


def _segments(numbered: DataFrame) -> DataFrame:
    parts = numbered.groupBy("meeting_id", "chunk", "utterance", "speaker").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.expr("trim(array_join(transform(array_sort(collect_list(struct(n, text))), w -> w.text), ''))").alias("text"),
    )
    return parts.where("text <> ''").selectExpr("meeting_id", "cast(row_number() OVER (PARTITION BY meeting_id ORDER BY chunk, utterance) - 1 AS bigint) AS idx", "speaker", "start_ms", "end_ms", "text")


def build_utterances(words: DataFrame, size: int = CHUNK_WORDS) -> DataFrame:
    """T6. Segments (meeting_id, idx from 0, speaker, start_ms, end_ms, text) of words with speakers: a new one where the
    speaker changes, after a pause of 4 s, after one of 1.5 s behind a sentence or comma, and at the end of a sentence
    once 45 s are over. Segments without text go and get no idx."""
    return _segments(_numbered(words, size))


def align(words: DataFrame, turns: DataFrame, alone: str = "S1", size: int = CHUNK_WORDS) -> DataFrame:
    """T7. Segments of words and turns. Meetings without turns have one speaker, `alone`. Changes are smoothed in chunks of about `size`
    words; a meeting of one chunk gets its utterances in the same pass, a longer one in a second, with chunks of its own."""
    named = _filled(_with_speakers(flatten_words(words), turns)).withColumn("speaker", F.coalesce("speaker", F.lit(alone)))
    kind, schema = words.schema["meeting_id"].dataType.simpleString(), f"{WORDS_SCHEMA}, chunk long, utterance long"
    done = written(in_order(_overlapping(named, size), ["meeting_id", "chunk"], ["r"], _smoothed_and_numbered, f"meeting_id {kind}, {schema}"), "smoothed-words")
    long = _numbered(done.where("utterance IS NULL"), size)
    return _segments(done.where("utterance IS NOT NULL").unionByName(long))


def rebuild_segments(segments: DataFrame, meeting_speakers: DataFrame, turns: DataFrame) -> DataFrame:
    """T8. meeting_speakers (meeting_id, key, label, status, talk_ms) with a row for each speaker of the segments that has
    none: `Speaker n`, unknown, no talk time. In meetings without turns (meeting_id) the talk time of S1 is that of all segments."""
    spoken = segments.where("speaker IS NOT NULL").select("meeting_id", F.col("speaker").alias("key")).distinct()
    new = spoken.join(meeting_speakers.select("meeting_id", "key"), ["meeting_id", "key"], "left_anti")
    new = new.selectExpr("meeting_id", "key", "concat('Speaker ', substr(key, 2)) AS label", "'unknown' AS status", "0L AS talk_ms")
    rows = meeting_speakers.select("meeting_id", "key", "label", "status", "talk_ms").unionByName(new)
    alone = segments.groupBy("meeting_id").agg(F.sum(F.expr("end_ms - start_ms")).alias("_all")).join(turns.select("meeting_id").distinct(), "meeting_id", "left_anti")
    rows = rows.join(alone.withColumn("key", F.lit("S1")), ["meeting_id", "key"], "left")
    return rows.selectExpr("meeting_id", "key", "label", "status", "coalesce(_all, talk_ms) AS talk_ms")


def single_speaker(meeting_speakers: DataFrame) -> DataFrame:
    """T8. Meetings set to one speaker keep S1 alone; those that lack it get one."""
    kept = meeting_speakers.where("key = 'S1'").select("meeting_id", "key", "label", "status")
    lacking = meeting_speakers.select("meeting_id").distinct().join(kept.select("meeting_id"), "meeting_id", "left_anti")
    return kept.unionByName(lacking.selectExpr("meeting_id", "'S1' AS key", "'Speaker 1' AS label", "'unknown' AS status"))


def _cue_numbers(rows: Iterator[tuple]) -> Iterator[tuple]:
    number, start, text = 0, None, ""
    for row in rows:
        word = row[3] or ""
        if start is None or row[5] - start > CUE_MS or len(text.strip()) + len(word) > CUE_CHARS:
            number, start, text = number + 1, row[4], ""
        text += word
        yield row[0], row[1], number, row[2], word, row[4], row[5]


def cues(words: DataFrame) -> DataFrame:
    """T9. Subtitle cues (meeting_id, idx, cue from 1, start_ms, end_ms, text) of the words (meeting_id, idx, pos, text,
    start_ms, end_ms) of each segment, packed up to 6 s and 84 characters."""
    kind = words.schema["meeting_id"].dataType.simpleString()
    rows = words.select("meeting_id", "idx", "pos", "text", "start_ms", "end_ms")
    packed = in_order(rows, ["meeting_id", "idx"], ["pos"], _cue_numbers, f"meeting_id {kind}, idx long, cue long, pos long, text string, start_ms long, end_ms long")
    return packed.groupBy("meeting_id", "idx", "cue").agg(
        F.expr("min_by(start_ms, pos)").alias("start_ms"), F.expr("max_by(end_ms, pos)").alias("end_ms"),
        F.expr("trim(array_join(transform(array_sort(collect_list(struct(pos, text))), w -> w.text), ''))").alias("text"),
    )
