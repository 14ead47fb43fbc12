"""The queries of decisions and corrections after a meeting, with DuckDB SQL that applies them one after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import decisions as ops
from convlake.plans.conversations import query

COLOR = "concat('#c', cast(id AS string))"


def _people(people):
    return people.selectExpr("id", "name", f"{COLOR} AS color")


def _speakers(meeting_speakers):
    return meeting_speakers.selectExpr(
        "meeting_id", "key", "label", "concat('#k', substr(key, 2)) AS color", "if(status = 'suggested', NULL, speaker_id) AS speaker_id", "status",
        "if(status IN ('suggested', 'unknown'), talk_ms % 10, NULL) AS suggested_id", "talk_ms",
    )


STATE = """people AS (SELECT id, name, '#c' || id AS color FROM speakers_fx),
ms AS (SELECT meeting_id, key, label, '#k' || substr(key, 2) AS color, CASE WHEN status <> 'suggested' THEN speaker_id END AS speaker_id, status,
         CASE WHEN status IN ('suggested', 'unknown') THEN talk_ms % 10 END AS suggested_id, talk_ms FROM meeting_speakers_fx)"""

# One decision of each meeting per step; a state is the list of the meeting's speakers.
STEPS = """
rec AS (
  SELECT meeting_id, 0::BIGINT AS n, list({'key': key, 'label': label, 'color': color, 'speaker_id': speaker_id, 'status': status, 'suggested_id': suggested_id, 'talk_ms': talk_ms} ORDER BY key) AS sp FROM ms GROUP BY meeting_id
  UNION ALL
  SELECT meeting_id, n + 1, CASE
    WHEN me IS NULL OR (action = 'confirm' AND pid IS NULL) OR (action = 'assign' AND who IS NOT NULL AND pid IS NULL) OR (action = 'assign' AND who IS NULL AND name IS NULL) THEN sp
    WHEN action = 'reject' THEN list_transform(sp, lambda x: CASE WHEN x.key = k THEN
      {'key': x.key, 'label': CASE WHEN x.status = 'auto' THEN 'Speaker ' || substr(k, 2) ELSE x.label END, 'color': x.color, 'speaker_id': CASE WHEN x.status = 'auto' THEN NULL ELSE x.speaker_id END, 'status': 'unknown', 'suggested_id': NULL::BIGINT, 'talk_ms': x.talk_ms} ELSE x END)
    WHEN action = 'unlink' THEN list_transform(sp, lambda x: CASE WHEN x.key = k THEN
      {'key': x.key, 'label': 'Speaker ' || substr(k, 2), 'color': x.color, 'speaker_id': NULL::BIGINT, 'status': 'unknown', 'suggested_id': x.suggested_id, 'talk_ms': x.talk_ms} ELSE x END)
    WHEN pid IS NULL THEN list_transform(sp, lambda x: CASE WHEN x.key = k THEN
      {'key': x.key, 'label': name, 'color': x.color, 'speaker_id': NULL::BIGINT, 'status': 'named', 'suggested_id': NULL::BIGINT, 'talk_ms': x.talk_ms} ELSE x END)
    ELSE list_transform(list_filter(sp, lambda x: other IS NULL OR x.key <> other.key), lambda x: CASE WHEN x.key = k THEN
      {'key': x.key, 'label': pname, 'color': pcolor, 'speaker_id': pid, 'status': 'confirmed', 'suggested_id': NULL::BIGINT, 'talk_ms': x.talk_ms + coalesce(other.talk_ms, 0)} ELSE x END)
    END
  FROM (
    SELECT a.*, p.id AS pid, p.name AS pname, p.color AS pcolor, list_filter(sp, lambda x: x.speaker_id = p.id AND x.key <> k)[1] AS other
    FROM (SELECT rec.meeting_id, rec.n, rec.sp, r.key AS k, r.action, r.who, r.name, list_filter(rec.sp, lambda x: x.key = r.key)[1] AS me,
            CASE r.action WHEN 'confirm' THEN coalesce(list_filter(rec.sp, lambda x: x.key = r.key)[1].speaker_id, list_filter(rec.sp, lambda x: x.key = r.key)[1].suggested_id) WHEN 'assign' THEN r.who END AS wanted
          FROM rec JOIN r ON r.meeting_id = rec.meeting_id AND r.rn = rec.n + 1) a LEFT JOIN everybody p ON p.id = wanted))
SELECT meeting_id, s.key, s.label, s.color, s.speaker_id, s.status, s.suggested_id, s.talk_ms FROM (SELECT meeting_id, unnest(sp) AS s FROM (SELECT meeting_id, arg_max(sp, n) AS sp FROM rec GROUP BY meeting_id))"""

NAMED = """d AS (SELECT * REPLACE (nullif(trim(name), '') AS name) FROM decisions_fx),
makers AS (SELECT d.*, row_number() OVER (PARTITION BY lower(name) ORDER BY seq, meeting_id, key) AS place FROM d
  WHERE action = 'assign' AND speaker_id IS NULL AND learn AND lower(name) NOT IN (SELECT lower(name) FROM people)),
born AS (SELECT *, (SELECT max(id) FROM people) + row_number() OVER (ORDER BY seq, meeting_id, key) AS id FROM makers WHERE place = 1),
everybody AS (SELECT * FROM people UNION ALL SELECT id, name, ['#8b5cf6', '#06b6d4', '#f59e0b', '#ec4899', '#10b981', '#3b82f6', '#ef4444', '#84cc16', '#f97316', '#14b8a6', '#a855f7', '#eab308', '#0ea5e9', '#f43f5e', '#22c55e', '#6366f1'][((id - 1) % 16 + 1)::INT] FROM born),
r AS (SELECT d.meeting_id, d.key, d.action, d.name, row_number() OVER (PARTITION BY d.meeting_id ORDER BY d.seq, d.key) AS rn,
        coalesce(d.speaker_id, p.id, CASE WHEN (d.seq, d.meeting_id, d.key) >= (b.seq, b.meeting_id, b.key) THEN b.id END) AS who
      FROM d LEFT JOIN people p ON d.speaker_id IS NULL AND lower(p.name) = lower(d.name) LEFT JOIN born b ON d.speaker_id IS NULL AND lower(b.name) = lower(d.name))"""


@query("l21_apply_decisions", ("meeting_speakers_fx", "decisions_fx", "speakers_fx"), f"WITH RECURSIVE {STATE}, {NAMED}, {STEPS}")
def l21(meeting_speakers, decisions, people):
    return ops.apply_decisions(_speakers(meeting_speakers), decisions, _people(people))["speakers"]


@query("l21_confirm_all", ("meeting_speakers_fx", "speakers_fx"), f"""WITH RECURSIVE {STATE}, everybody AS (SELECT * FROM people), told AS (
  SELECT meeting_id, key, CASE WHEN status IN ('auto', 'confirmed') THEN speaker_id WHEN status = 'suggested' THEN suggested_id END AS who FROM ms WHERE meeting_id % 2 = 0),
r AS (SELECT meeting_id, key, 'assign' AS action, NULL::VARCHAR AS name, who, row_number() OVER (PARTITION BY meeting_id ORDER BY key) AS rn FROM told WHERE who IS NOT NULL), {STEPS}""")
def l21_all(meeting_speakers, people):
    rows = _speakers(meeting_speakers)
    return ops.confirm_all(rows, rows.where("meeting_id % 2 = 0"), _people(people))["speakers"]


EDITED = """ms AS (SELECT meeting_id, key, speaker_id, talk_ms, substr(key, 2)::BIGINT AS number FROM meeting_speakers_fx),
top AS (SELECT meeting_id, max(number) AS top FROM ms GROUP BY meeting_id),
e0 AS (SELECT e.*, s.speaker AS first_speaker, s.start_ms, s.end_ms, top + count(*) FILTER (WHERE e.speaker = 'new') OVER (PARTITION BY e.meeting_id ORDER BY e.seq) AS number, top
  FROM edits_fx e JOIN segments_fx s ON s.meeting_id = e.meeting_id AND s.idx = e.idx JOIN top ON top.meeting_id = e.meeting_id),
e1 AS (SELECT e0.*, CASE WHEN e0.speaker = 'new' THEN 'S' || e0.number WHEN m.key IS NOT NULL OR (try_cast(substr(e0.speaker, 2) AS BIGINT) BETWEEN top + 1 AND e0.number) THEN e0.speaker END AS given, m.speaker_id
  FROM e0 LEFT JOIN ms m ON m.meeting_id = e0.meeting_id AND m.key = e0.speaker AND e0.speaker <> 'new'),"""


@query("l22_segment_edits", ("segments_fx", "meeting_speakers_fx", "edits_fx"), f"""WITH {EDITED}
said AS (SELECT meeting_id, idx, arg_max(trim(text), seq) FILTER (WHERE trim(text) <> '') AS said, arg_max(given, seq) FILTER (WHERE given IS NOT NULL) AS told FROM e1 GROUP BY 1, 2)
SELECT s.meeting_id, s.idx, coalesce(told, speaker) AS speaker, coalesce(said, text) AS text, start_ms, end_ms, s.idx % 10 = 3 OR said IS NOT NULL OR told IS NOT NULL AS edited
FROM segments_fx s LEFT JOIN said ON said.meeting_id = s.meeting_id AND said.idx = s.idx""")
def l22(segments, meeting_speakers, edits):
    return ops.apply_segment_edits(segments.withColumn("edited", F.expr("idx % 10 = 3")), edits, meeting_speakers.withColumn("color", F.lit("#8b5cf6")))["segments"]


@query("l22_talk_times", ("segments_fx", "meeting_speakers_fx", "edits_fx"), f"""WITH {EDITED}
held AS (SELECT *, coalesce(lag(given) OVER (PARTITION BY meeting_id, idx ORDER BY seq), first_speaker) AS before FROM e1 WHERE given IS NOT NULL),
steps AS (SELECT meeting_id, before AS key, seq, 0 AS o, start_ms - end_ms AS d FROM held UNION ALL SELECT meeting_id, given, seq, 1, end_ms - start_ms FROM held),
keys AS (SELECT meeting_id, key, talk_ms FROM ms UNION ALL SELECT meeting_id, given, 0 FROM e1 WHERE speaker = 'new')
SELECT k.meeting_id, k.key, coalesce(list_reduce(list_prepend(any_value(talk_ms)::BIGINT, list(d::BIGINT ORDER BY seq, o) FILTER (WHERE d IS NOT NULL)), lambda a, b: greatest(0, a + b)), any_value(talk_ms))::BIGINT AS talk_ms
FROM keys k LEFT JOIN steps s ON s.meeting_id = k.meeting_id AND s.key = k.key GROUP BY k.meeting_id, k.key""")
def l22_talk(segments, meeting_speakers, edits):
    done = ops.apply_segment_edits(segments.withColumn("edited", F.lit(False)), edits, meeting_speakers.withColumn("color", F.lit("#8b5cf6")))
    return done["speakers"].select("meeting_id", "key", "talk_ms")


@query("l22_learn_clips", ("segments_fx", "meeting_speakers_fx", "edits_fx"), f"""WITH {EDITED}
x AS (SELECT 1) SELECT meeting_id, idx, seq, speaker_id, start_ms, least(end_ms, start_ms + 12000) AS end_ms FROM e1 WHERE given IS NOT NULL AND learn AND speaker_id IS NOT NULL AND end_ms - start_ms >= 2500""")
def l22_clips(segments, meeting_speakers, edits):
    return ops.apply_segment_edits(segments.withColumn("edited", F.lit(False)), edits, meeting_speakers.withColumn("color", F.lit("#8b5cf6")))["clips"]
