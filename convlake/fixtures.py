"""Views of the conversation data model derived from the driver's tables; times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = """
SELECT meeting_id, idx, speaker, text, start_ms, start_ms + dur_ms AS end_ms FROM (
  SELECT meeting_id, idx, speaker, text, dur_ms,
         CAST(COALESCE(SUM(dur_ms + gap_ms) OVER (PARTITION BY meeting_id ORDER BY idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
  FROM (SELECT conv_id AS meeting_id, CAST(turn AS BIGINT) AS idx, text,
               CASE role WHEN 'user' THEN 'S1' WHEN 'assistant' THEN 'S2' ELSE 'S3' END AS speaker,
               CAST(400 + 60 * length(text) AS BIGINT) AS dur_ms,
               CAST(200 + 700 * ((conv_id * 7 + turn * 3) % 7) AS BIGINT) AS gap_ms
        FROM conversations) a) b"""

TURNS = """
SELECT meeting_id, speaker,
       GREATEST(0, start_ms + (((meeting_id * 5 + idx * 11) % 5) - 2) * 150) AS start_ms,
       end_ms + (((meeting_id * 3 + idx * 7) % 5) - 1) * 600 AS end_ms
FROM segments_fx WHERE (meeting_id + idx) % 9 <> 0"""

SAMPLES = """
SELECT vec_id AS id, CAST(label AS BIGINT) AS speaker_id, CAST(vec_id % 25 AS BIGINT) AS meeting_id,
       CAST(0 AS BIGINT) AS start_ms, CAST(1500 + 500 * ((vec_id * 7) % 23) AS BIGINT) AS end_ms,
       CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'cur' END AS model, embedding
FROM embeddings"""

MEETING_SPEAKERS = """
SELECT meeting_id, speaker AS key, CONCAT('Speaker ', substr(speaker, 2)) AS label,
       CASE WHEN (meeting_id + ascii(substr(speaker, 2))) % 4 = 0 THEN NULL
            ELSE CAST((meeting_id * 3 + ascii(substr(speaker, 2))) % 10 AS BIGINT) END AS speaker_id,
       CASE (meeting_id + ascii(substr(speaker, 2))) % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'auto'
            WHEN 2 THEN 'confirmed' ELSE 'suggested' END AS status,
       CAST(SUM(end_ms - start_ms) AS BIGINT) AS talk_ms
FROM segments_fx GROUP BY meeting_id, speaker"""

# Three decisions on each speaker: by id (two of twelve are nobody's), by name known or new, to learn or not.
DECISIONS = """
SELECT meeting_id, (j * 3 + (n + meeting_id) % 3) * 10 + n AS seq, key,
       CASE a WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' WHEN 2 THEN 'unlink' ELSE 'assign' END AS action,
       CASE WHEN a = 3 THEN (meeting_id + j) % 12 END AS speaker_id,
       CASE WHEN a = 4 THEN CONCAT(' person ', CAST((meeting_id + n) % 10 AS {string})) WHEN a > 4 THEN CONCAT('Guest ', CAST((meeting_id * 3 + j + n) % 5 AS {string}), ' ') END AS name,
       a <> 6 AS learn, CAST(NULL AS {string}) AS target
FROM (SELECT meeting_id, key, n, CAST(j AS BIGINT) AS j, (meeting_id * 5 + n * 3 + j * 2) % 7 AS a
      FROM (SELECT meeting_id, key, CAST(substr(key, 2) AS BIGINT) AS n FROM meeting_speakers_fx) m CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) js) x"""

# Up to three edits of every second segment: texts, keys known and not, new speakers.
EDITS = """
SELECT meeting_id, idx, j * 100000 + (idx * 7) % 1000 * 100 + idx % 100 AS seq,
       CASE (idx + j) % 3 WHEN 0 THEN CONCAT(' Said ', CAST(idx AS {string}), ' ') WHEN 1 THEN ' ' END AS text,
       CASE (meeting_id + idx + j) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'S1' WHEN 2 THEN 'S4' WHEN 3 THEN 'S77' ELSE '' END AS speaker,
       (idx + j) % 2 = 0 AS learn
FROM segments_fx CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) js WHERE idx % 2 = 0 AND (idx + meeting_id) % 4 >= j"""

SPEAKERS = "SELECT DISTINCT CAST(label AS BIGINT) AS id, CONCAT('Person ', CAST(label AS {string})) AS name FROM embeddings"

PERF = """
SELECT event_type AS key, value,
       CAST(ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS seq FROM events"""

AUDIO = """
SELECT user_id AS meeting_id, value,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events"""

CHUNKS = "SELECT user_id AS rid, event_id AS seq, ts, CAST(length(props) AS BIGINT) AS n_bytes FROM events"

WORDS = """
SELECT meeting_id, idx, CAST(pos AS BIGINT) AS pos, CONCAT(' ', w) AS text,
       start_ms + (pos * (end_ms - start_ms)) div n AS start_ms,
       start_ms + ((pos + 1) * (end_ms - start_ms)) div n AS end_ms
FROM (SELECT *, size(ws) AS n FROM (SELECT *, filter(split(text, '[ \\n\\t]+'), x -> x <> '') AS ws FROM segments_fx))
LATERAL VIEW posexplode(ws) AS pos, w"""

WORDS_SQL = """
SELECT meeting_id, idx, pos - 1 AS pos, ' ' || ws[pos] AS text,
       start_ms + ((pos - 1) * (end_ms - start_ms)) // n AS start_ms,
       start_ms + (pos * (end_ms - start_ms)) // n AS end_ms
FROM (SELECT *, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS pos
      FROM (SELECT *, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: x <> '') AS ws FROM segments_fx))"""

LINES = "SELECT doc_id AS meeting_id, CAST(pos AS BIGINT) AS idx, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) AS pos, line"
LINES_SQL = """
SELECT doc_id AS meeting_id, pos - 1 AS idx, ls[pos] AS line
FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""

ACTIONS = """
SELECT meeting_id, idx, line AS task,
       CASE idx % 3 WHEN 0 THEN 'Speaker 1' WHEN 1 THEN 'N/A' ELSE '' END AS owner,
       CASE idx % 4 WHEN 0 THEN 'Friday' WHEN 1 THEN 'TBD' WHEN 2 THEN '' ELSE 'unknown' END AS due,
       CONCAT(lpad(CAST(CAST(floor(idx * 37 / 3600) AS BIGINT) AS STRING), 2, '0'), ':',
              lpad(CAST(CAST(floor(idx * 37 / 60) AS BIGINT) % 60 AS STRING), 2, '0'), ':', lpad(CAST(idx * 37 % 60 AS STRING), 2, '0')) AS time,
       (meeting_id + idx) % 2 = 0 AS done, CAST(floor(n_chars / 10) AS BIGINT) AS duration_s
FROM (SELECT * FROM note_lines_fx) l JOIN (SELECT doc_id, n_chars FROM documents) d ON d.doc_id = l.meeting_id WHERE idx % 5 = 0"""

MEETINGS = """
SELECT meeting_id AS id, concat('Talk ', CAST(meeting_id AS {string}), ' ', substr(text, 1, 24)) AS title, substr(text, 1, 80) AS summary,
       CAST(1704067200 + meeting_id * 5400 AS BIGINT) AS created_s,
       CASE WHEN meeting_id % 3 = 0 THEN NULL ELSE CAST(1704067200 - (meeting_id % 11) * 86400 AS BIGINT) END AS recorded_s,
       CAST(10 + meeting_id * 37 % 7000 AS BIGINT) AS duration_s, meeting_id % 4 = 0 AS favorite
FROM segments_fx WHERE idx = 0"""

# Windows of 20 frames, 3 local speakers each, every 4 frames; some vectors are missing.
WINDOWS = """
SELECT meeting_id, q {div} 3 AS chunk, q % 3 AS local, vec_id, CASE WHEN vec_id % 7 = 3 THEN NULL ELSE embedding END AS embedding, {frames} AS frames
FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(vec_id % 10 AS BIGINT) AS meeting_id, CAST(vec_id {div} 10 AS BIGINT) AS q, embedding FROM embeddings) v"""
WINDOWS_SPARK = WINDOWS.format(div="div", frames="transform(sequence(0, 19), f -> CAST((vec_id * 7 + f * 3) % 5 < 3 AS BIGINT))")
WINDOWS_DUCK = WINDOWS.format(div="//", frames="list_transform(range(0, 20), lambda f: CAST((vec_id * 7 + f * 3) % 5 < 3 AS BIGINT))")

VIEWS = {
    "segments_fx": (SEGMENTS, SEGMENTS, ["conversations"]),
    "turns_fx": (TURNS, TURNS, ["segments_fx"]),
    "samples_fx": (SAMPLES, SAMPLES, ["embeddings"]),
    "meeting_speakers_fx": (MEETING_SPEAKERS, MEETING_SPEAKERS, ["segments_fx"]),
    "speakers_fx": (SPEAKERS.format(string="STRING"), SPEAKERS.format(string="VARCHAR"), ["embeddings"]),
    "decisions_fx": (DECISIONS.format(string="STRING"), DECISIONS.format(string="VARCHAR"), ["meeting_speakers_fx"]),
    "edits_fx": (EDITS.format(string="STRING"), EDITS.format(string="VARCHAR"), ["segments_fx"]),
    "perf_fx": (PERF, PERF, ["events"]),
    "audio_fx": (AUDIO, AUDIO, ["events"]),
    "chunks_fx": (CHUNKS, CHUNKS, ["events"]),
    "words_fx": (WORDS, WORDS_SQL, ["segments_fx"]),
    "note_lines_fx": (LINES, LINES_SQL, ["documents"]),
    "meetings_fx": (MEETINGS.format(string="STRING"), MEETINGS.format(string="VARCHAR"), ["segments_fx"]),
    "windows_fx": (WINDOWS_SPARK, WINDOWS_DUCK, ["embeddings"]),
    "actions_fx": (ACTIONS, ACTIONS, ["note_lines_fx", "documents"]),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view derived from them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, _, needs = VIEWS[name]
    frames = {n: load(spark, sf_dir, n) for n in needs}
    for n in needs:
        text = text.replace(f"FROM {n}", "FROM {" + n + "}")
    return spark.sql(text, **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views, and those that they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in VIEWS[name][2]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    sql = sql.strip()
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"
