"""Meeting analytics: runs, shares, monologues, timings (M) and names, marks, chapters (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speaker_stats(segments: DataFrame, meeting_speakers: DataFrame | None = None) -> DataFrame:
    """M1. Per meeting and speaker: turns (runs of one speaker), words, talk_ms, longest_ms (longest run, from
    the start of its first segment to the end of its last); zeros for those of
    meeting_speakers (meeting_id, key) that say nothing."""
    words = "size(filter(split(text, '\\\\s+'), w -> w <> ''))"
    rows = segments.selectExpr("meeting_id", "idx", "speaker", "start_ms", "end_ms", f"cast({words} AS bigint) AS words")
    rows = rows.selectExpr("*", "coalesce(speaker <> lag(speaker) OVER (PARTITION BY meeting_id ORDER BY idx), true) AS change")
    rows = rows.selectExpr("*", "sum(cast(change AS bigint)) OVER (PARTITION BY meeting_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run")
    runs = rows.groupBy("meeting_id", "speaker", "run").agg(F.sum("words").alias("words"), F.sum(F.expr("end_ms - start_ms")).alias("talk"), F.expr("max_by(end_ms, idx) - min_by(start_ms, idx)").alias("long"))
    made = runs.groupBy("meeting_id", "speaker").agg(F.count("*").alias("turns"), F.sum("words").alias("words"), F.sum("talk").alias("talk_ms"), F.max("long").alias("longest_ms"))
    if meeting_speakers is None:
        return made
    silent = meeting_speakers.selectExpr("meeting_id", "key AS speaker").distinct().join(made, ["meeting_id", "speaker"], "left_anti")
    return made.unionByName(silent.selectExpr("*", *[f"0L AS {c}" for c in ("turns", "words", "talk_ms", "longest_ms")]))


def talk_share(stats: DataFrame) -> DataFrame:
    """M2. Percent of the meeting's talk time, half up; 0 where nobody talks."""
    total = "sum(talk_ms) OVER (PARTITION BY meeting_id)"
    return stats.selectExpr("meeting_id", "speaker", f"if({total} = 0, 0L, cast(floor(100D * talk_ms / {total} + 0.5D) AS bigint)) AS share")


def meeting_stats(stats: DataFrame) -> DataFrame:
    """M3. Turns, words, words a minute and the longest monologue with its speaker (first listed on ties)."""
    out = stats.groupBy("meeting_id").agg(
        F.sum("turns").alias("turns"), F.sum("words").alias("words"), F.sum("talk_ms").alias("talk"), F.max("longest_ms").alias("longest_ms"),
        F.expr("min_by(speaker, struct(-longest_ms, speaker))").alias("longest_speaker"),
    )
    return out.selectExpr("meeting_id", "turns", "words", "cast(floor(words / greatest(1D, talk / 60000D) + 0.5D) AS bigint) AS words_per_minute", "longest_ms", "longest_speaker")


def longest_segment(segments: DataFrame) -> DataFrame:
    """M4. The longest segment of each speaker, the first on ties."""
    return segments.groupBy("meeting_id", "speaker").agg(F.expr("min_by(struct(idx, end_ms - start_ms AS ms), struct(start_ms - end_ms, idx))").alias("s")).selectExpr("meeting_id", "speaker", "s.idx", "s.ms")


LEAST_OBSERVED_S = 60
FOLD_ROWS = 4096


def observed(meetings: DataFrame) -> DataFrame:
    """M5. Observations (key, seq, value) of meetings (key, seq, value, duration_s) that last over a minute."""
    return meetings.where(f"duration_s > {LEAST_OBSERVED_S}").select("key", "seq", "value")


def perf_ema(observations: DataFrame, chunk: int = FOLD_ROWS) -> DataFrame:
    """M5. Moving average per key in order of seq: the first value as it is, 0.5 while fewer than 3 were seen, then 0.3.

    Chunks of a key by seq are folded each on its own: to its first three values, and to what the rest does to any average
    (x becomes keep * x + add) if 0, 1, 2 or 3 values were seen before. A key's chunks are then folded in order."""
    rows = observations.groupBy("key", F.expr(f"seq div {chunk}").alias("c")).agg(F.expr("transform(array_sort(collect_list(struct(seq, cast(value AS double) AS value))), o -> o.value)").alias("v"))
    rest = "transform(sequence(0, 3), j -> aggregate(if(j >= size(v), slice(v, 1, 0), slice(v, j + 1, size(v))), struct(1D AS keep, 0D AS add), (s, o) -> struct(0.7D * s.keep AS keep, 0.7D * s.add + 0.3D * o AS add)))"
    parts = rows.selectExpr("key", "struct(c, slice(v, 1, 3) AS first, cast(size(v) AS bigint) AS n, " + rest + " AS rest) AS p")
    step = "struct(if(s.n = 0, o, s.x + 0.5D * (o - s.x)) AS x, s.n + 1L AS n)"
    begin = f"aggregate(slice(p.first, 1, cast(greatest(0L, 3L - s.n) AS int)), s, (s, o) -> {step})"
    after = "p.rest[cast(greatest(0L, 3L - s.n) AS int)]"
    fold = f"aggregate(array_sort(collect_list(p)), struct(cast(NULL AS double) AS x, 0L AS n), (s, p) -> struct(if({after}.keep = 1D, {begin}.x, {after}.keep * {begin}.x + {after}.add) AS x, s.n + p.n AS n))"
    return parts.groupBy("key").agg(F.expr(fold).alias("s")).selectExpr("key", "s.x AS value", "s.n AS samples")


def meeting_totals(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """M7. Words, segments, speech and learned samples of each meeting."""
    words = "size(filter(split(text, '\\\\s+'), w -> w <> ''))"
    rows = segments.groupBy("meeting_id").agg(F.sum(F.expr(f"cast({words} AS bigint)")).alias("words"), F.count("*").alias("segments"), F.sum(F.expr("end_ms - start_ms")).alias("speech_ms"))
    learned = samples.groupBy("meeting_id").agg(F.count("*").alias("learned"))
    return rows.join(learned, "meeting_id", "left").selectExpr("meeting_id", "words", "segments", "speech_ms", "coalesce(learned, 0L) AS learned")


def speaker_names(meeting_speakers: DataFrame, speakers: DataFrame) -> DataFrame:
    """P1. The library's name, else the label, else the key."""
    known = speakers.selectExpr("id AS speaker_id", "name")
    return meeting_speakers.join(known, "speaker_id", "left").selectExpr("meeting_id", "key", "coalesce(nullif(name, ''), nullif(label, ''), key) AS name")


def speaker_rows(meeting_speakers: DataFrame, speakers: DataFrame) -> DataFrame:
    """P1. The listing of a meeting's speakers: name, number of the key (0 without one) and the name of who is suggested, by number."""
    known = speakers.select("id", "name")
    rows = meeting_speakers.join(known.selectExpr("id AS speaker_id", "name AS speaker_name"), "speaker_id", "left")
    rows = rows.join(known.selectExpr("id AS suggested_id", "name AS suggested_name"), "suggested_id", "left")
    name = "coalesce(nullif(speaker_name, ''), nullif(label, ''), key) AS name"
    return rows.selectExpr("meeting_id", "key", "coalesce(try_cast(substr(key, 2) AS bigint), 0L) AS number", name, "status", "suggested_name").orderBy("meeting_id", "number", "key")


def place_bookmarks(segments: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """P7. Each bookmark (meeting_id, at_ms) stands before the first segment that starts at or after it; later ones vanish."""
    rows = segments.selectExpr("meeting_id", "start_ms AS at", "0 AS mark", "idx").unionByName(bookmarks.selectExpr("meeting_id", "at_ms AS at", "1 AS mark", "cast(NULL AS bigint) AS idx"))
    ahead = "last_value(idx) IGNORE NULLS OVER (PARTITION BY meeting_id ORDER BY at DESC, mark, idx DESC ROWS UNBOUNDED PRECEDING)"
    return rows.selectExpr("meeting_id", "at AS at_ms", "mark", f"{ahead} AS idx").where("mark = 1 AND idx IS NOT NULL").drop("mark")


def chapter_at(chapters: DataFrame, times: DataFrame) -> DataFrame:
    """P8. The latest chapter (meeting_id, start_ms, title) that starts at or before each time (meeting_id, at_ms)."""
    rows = chapters.selectExpr("meeting_id", "start_ms AS at", "0 AS asked", "title").unionByName(times.selectExpr("meeting_id", "at_ms AS at", "1 AS asked", "cast(NULL AS string) AS title"))
    last = "last_value(title) IGNORE NULLS OVER (PARTITION BY meeting_id ORDER BY at, asked ROWS UNBOUNDED PRECEDING)"
    return rows.selectExpr("meeting_id", "at AS at_ms", "asked", f"{last} AS title").where("asked = 1").drop("asked")


def speaker_at(segments: DataFrame, times: DataFrame) -> DataFrame:
    """P9. Who speaks at each time (meeting_id, at_ms): of the first segment that ends at or after it, else the last one,
    if the time is within half a second of that segment; else null."""
    segment = "struct(start_ms, end_ms, idx, speaker)"
    rows = segments.selectExpr("meeting_id", "end_ms AS at", "1 AS known", f"{segment} AS s")
    rows = rows.unionByName(times.selectExpr("meeting_id", "at_ms AS at", "0 AS known"), allowMissingColumns=True)
    ahead = "last_value(s) IGNORE NULLS OVER (PARTITION BY meeting_id ORDER BY at DESC, known DESC, s.idx DESC ROWS UNBOUNDED PRECEDING)"
    behind = "last_value(s) IGNORE NULLS OVER (PARTITION BY meeting_id ORDER BY at, known, s.idx ROWS UNBOUNDED PRECEDING)"
    met = rows.selectExpr("meeting_id", "at AS at_ms", "known", f"coalesce({ahead}, {behind}) AS s").where("known = 0")
    return met.selectExpr("meeting_id", "at_ms", "if(at_ms BETWEEN s.start_ms - 500 AND s.end_ms + 500, s.speaker, NULL) AS speaker")
