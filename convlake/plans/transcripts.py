"""Registered queries from words to segments, cues and exported documents."""

from __future__ import annotations

from convlake.operators import align, stats
from convlake.plans.conversations import ASSIGNED, query
from convlake.sources import exports

FILLED = f"""{ASSIGNED}, fl AS (SELECT meeting_id, n, coalesce(
  last_value(speaker IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY n ROWS UNBOUNDED PRECEDING),
  first_value(speaker IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM a
), nw AS MATERIALIZED (SELECT f.meeting_id, n, text, start_ms, end_ms, coalesce(speaker, 'S1') AS speaker FROM f JOIN fl USING (meeting_id, n))"""


def _named(words, turns):
    flat = align.flatten_words(words)
    return flat.join(align.fill_gaps(align.assign_speakers(flat, turns)), ["meeting_id", "n"]).selectExpr("meeting_id", "n", "text", "start_ms", "end_ms", "coalesce(speaker, 'S1') AS speaker")


ENDS = "right(trim({t}), 1) IN ('.', '?', '!', '…', '。', '？', '！')"

# Runs in order, each seeing what became of the one before; then words in order, with the four words around a change as state.
SMOOTHED = f"""{FILLED}, we AS (SELECT *, {ENDS.format(t="text")} AS e FROM nw), rw AS (
  SELECT *, sum(c) OVER (PARTITION BY meeting_id ORDER BY n) AS r FROM (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY meeting_id ORDER BY n) THEN 0 ELSE 1 END AS c FROM we)
), ru AS MATERIALIZED (
  SELECT *, lag(e_last) OVER (PARTITION BY meeting_id ORDER BY r) AS e_before, lead(speaker) OVER (PARTITION BY meeting_id ORDER BY r) AS after FROM (
    SELECT meeting_id, r, speaker, count(*) AS words, arg_max(end_ms, n) - arg_min(start_ms, n) AS ms, arg_max(e, n) AS e_last FROM rw GROUP BY 1, 2, 3)
), un AS (
  SELECT meeting_id, r, speaker AS now FROM ru WHERE r = 1
  UNION ALL
  SELECT ru.meeting_id, ru.r, CASE WHEN words <= 2 AND ms < 1000 AND after = now AND now <> speaker AND NOT e_before AND NOT e_last THEN now ELSE speaker END FROM un JOIN ru ON ru.meeting_id = un.meeting_id AND ru.r = un.r + 1
), x AS MATERIALIZED (
  SELECT meeting_id, n AS k, now, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3, lead(e) OVER w AS f1, lead(now) OVER w AS w1, count(*) OVER (PARTITION BY meeting_id) AS last
  FROM rw JOIN un USING (meeting_id, r) WINDOW w AS (PARTITION BY meeting_id ORDER BY n)
), sn AS (
  SELECT meeting_id, k, last, NULL::VARCHAR AS a, NULL::VARCHAR AS b, now AS c, w1 AS d FROM x WHERE k = 1
  UNION ALL
  SELECT meeting_id, k, last, CASE WHEN how = 2 THEN c ELSE a END, CASE WHEN how IN (1, 2) THEN c ELSE b END, CASE WHEN how IN (3, 4) THEN b ELSE c END, CASE WHEN how = 4 THEN b ELSE d END FROM (
    SELECT *, CASE WHEN c = b OR e1 THEN 0 WHEN k > 2 AND e2 THEN 1 WHEN k > 3 AND a = b AND e3 AND NOT e2 THEN 2 WHEN k < last AND e THEN 3 WHEN k + 1 < last AND c = d AND f1 AND NOT e THEN 4 ELSE 0 END AS how
    FROM (SELECT x.meeting_id, x.k, x.last, sn.b AS a, sn.c AS b, sn.d AS c, x.w1 AS d, e, e1, e2, e3, f1 FROM sn JOIN x ON x.meeting_id = sn.meeting_id AND x.k = sn.k + 1))
), sm AS MATERIALIZED (
  SELECT meeting_id, k - 2 AS n, a AS speaker FROM sn WHERE k > 2 UNION ALL SELECT meeting_id, k - 1, b FROM sn WHERE k = last AND k > 1 UNION ALL SELECT meeting_id, k, c FROM sn WHERE k = last)"""


@query("t5_smooth_speakers", ("words_fx", "turns_fx"), f"WITH RECURSIVE {SMOOTHED} SELECT * FROM sm")
def t5(words, turns):
    return align.smooth_speakers(_named(words, turns)).select("meeting_id", "n", "speaker")



UTTERANCES = f"""ut AS (
  SELECT meeting_id, n, speaker, text, start_ms AS us, end_ms AS ue, 1 AS u FROM sw WHERE n = 1
  UNION ALL
  SELECT meeting_id, n, speaker, text, CASE WHEN new THEN start_ms ELSE us END, CASE WHEN new THEN end_ms ELSE greatest(ue, end_ms) END, CASE WHEN new THEN u + 1 ELSE u END FROM (
    SELECT w.*, us, ue, u, w.speaker <> ut.speaker OR start_ms - ue > 4000 OR (start_ms - ue > 1500 AND ({ENDS.format(t='ut.text')} OR right(trim(ut.text), 1) = ','))
           OR (ue - us > 45000 AND {ENDS.format(t='ut.text')}) AS new
    FROM ut JOIN sw w ON w.meeting_id = ut.meeting_id AND w.n = ut.n + 1)
), jo AS (
  SELECT meeting_id, u, speaker, min(us) AS start_ms, max(ue) AS end_ms, trim(string_agg(text, '' ORDER BY n)) AS text FROM ut GROUP BY ALL
) SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY u) - 1 AS idx, speaker, start_ms, end_ms, text FROM jo WHERE text <> ''"""


@query("t6_build_utterances", ("words_fx", "turns_fx"), f"WITH RECURSIVE {FILLED}, sw AS (SELECT * FROM nw), {UTTERANCES}")
def t6(words, turns):
    return align.build_utterances(_named(words, turns))


@query("t7_align", ("words_fx", "turns_fx"), f"WITH RECURSIVE {SMOOTHED}, sw AS MATERIALIZED (SELECT nw.* REPLACE (sm.speaker AS speaker) FROM nw JOIN sm USING (meeting_id, n)), {UTTERANCES}")
def t7(words, turns):
    return align.align(words, turns)


@query("t8_rebuild_segments", ("segments_fx", "meeting_speakers_fx", "turns_fx"), """WITH k AS (SELECT meeting_id, key, label, status, talk_ms FROM meeting_speakers_fx WHERE meeting_id % 2 = 0 OR key <> 'S' || (1 + meeting_id % 3)),
n AS (SELECT * FROM k UNION ALL SELECT DISTINCT meeting_id, speaker, 'Speaker ' || substr(speaker, 2), 'unknown', 0 FROM segments_fx s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.meeting_id = s.meeting_id AND k.key = s.speaker))
SELECT meeting_id, key, label, status, CASE WHEN key = 'S1' AND (meeting_id % 3 = 1 OR NOT EXISTS (SELECT 1 FROM turns_fx t WHERE t.meeting_id = n.meeting_id))
  THEN (SELECT sum(end_ms - start_ms)::BIGINT FROM segments_fx s WHERE s.meeting_id = n.meeting_id) ELSE talk_ms END AS talk_ms FROM n""")
def t8(segments, meeting_speakers, turns):
    return align.rebuild_segments(segments, meeting_speakers.where("meeting_id % 2 = 0 OR key <> concat('S', 1 + meeting_id % 3)"), turns.where("meeting_id % 3 <> 1"))


CUES = """cw AS MATERIALIZED (SELECT * FROM words_fx), cu AS (
  SELECT meeting_id, idx, pos, text AS acc, start_ms AS cs, start_ms, end_ms, text, 1 AS cue FROM cw WHERE pos = 0
  UNION ALL
  SELECT meeting_id, idx, pos, CASE WHEN new THEN text ELSE acc || text END, CASE WHEN new THEN start_ms ELSE cs END, start_ms, end_ms, text, CASE WHEN new THEN cue + 1 ELSE cue END FROM (
    SELECT w.*, acc, cs, cue, w.end_ms - cs > 6000 OR length(trim(acc)) + length(w.text) > 84 AS new
    FROM cu JOIN cw w ON w.meeting_id = cu.meeting_id AND w.idx = cu.idx AND w.pos = cu.pos + 1)
), cg AS (
  SELECT meeting_id, idx, cue::BIGINT AS cue, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, trim(string_agg(text, '' ORDER BY pos)) AS text FROM cu GROUP BY ALL
)"""


@query("t9_cues", ("words_fx",), f"WITH RECURSIVE {CUES} SELECT * FROM cg")
def t9(words):
    return align.cues(words)


CLOCK = "lpad(({t} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({t} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({t} % 60)::VARCHAR, 2, '0')"
NAMES = "nm AS (SELECT meeting_id, key, coalesce(nullif(name, ''), nullif(label, ''), key) AS name FROM meeting_speakers_fx m LEFT JOIN speakers_fx s ON s.id = m.speaker_id)"
EXPORT_VIEWS = ("segments_fx", "meeting_speakers_fx", "speakers_fx", "meetings_fx")


def _meetings(meetings):
    notes = "from_json(to_json(named_struct('summary', summary, 'key_points', array('One', title), 'action_items', array(named_struct('task', 'Call', 'owner', 'Ann', 'due', '', 't', 61L, 'done', false)))), '%s')" % exports.NOTES
    return meetings.selectExpr("id", "title", "coalesce(recorded_s, created_s) AS date_s", "duration_s", f"{notes} AS notes")


# DuckDB's upper gives ẞ for ß, Spark's gives SS.
@query("s10_export_text", EXPORT_VIEWS, f"""WITH {NAMES}, sd AS (
  SELECT g.meeting_id, idx, coalesce(name, speaker) AS name, text, '[' || {CLOCK.format(t='(start_ms // 1000)')} || '] ' AS tm, end_ms - start_ms AS ms
  FROM segments_fx g LEFT JOIN nm ON nm.meeting_id = g.meeting_id AND nm.key = g.speaker
), sp AS (SELECT meeting_id, string_agg(name, ', ' ORDER BY ms DESC, name) AS who FROM (SELECT meeting_id, name, sum(ms) AS ms FROM sd GROUP BY ALL) GROUP BY 1
), tx AS (SELECT meeting_id, string_agg(tm || name || ': ' || text || chr(10), chr(10) ORDER BY idx) AS body FROM sd GROUP BY 1)
SELECT m.id AS meeting_id, concat_ws(chr(10), replace(upper(title), 'ẞ', 'SS'), strftime(make_timestamp(coalesce(recorded_s, created_s) * 1000000), '%A %d %B %Y, %H:%M') || ' · Duration ' || {CLOCK.format(t='duration_s')} || ' · Speakers: ' || who,
  repeat('=', 72), '', 'SUMMARY', summary, '', 'KEY POINTS', '  • One', '  • ' || title, '', 'ACTION ITEMS', '[ ] Call (Ann) [00:01:01]', '', 'TRANSCRIPT', repeat('-', 72), rtrim(body, chr(10))) || chr(10) AS text
FROM meetings_fx m JOIN sp ON sp.meeting_id = m.id JOIN tx ON tx.meeting_id = m.id""")
def s10(segments, meeting_speakers, people, meetings):
    return exports.export_text(segments, stats.speaker_names(meeting_speakers, people), _meetings(meetings))


VTT = "lpad(({t} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({t} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({t} // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad(({t} % 1000)::VARCHAR, 3, '0')"


@query("s11_export_subtitles", ("words_fx",), f"""WITH RECURSIVE {CUES} SELECT meeting_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(
  {VTT.format(t='start_ms')} || ' --> ' || {VTT.format(t='greatest(end_ms, start_ms + 300)')} || chr(10) || '<v S' || (idx % 2) || '>' || text || chr(10), chr(10) ORDER BY idx, cue) AS text FROM cg GROUP BY 1""")
def s11_vtt(words):
    return exports.export_subtitles(align.cues(words).selectExpr("*", "concat('S', idx % 2) AS name"), "vtt")


@query("s12_export_json", EXPORT_VIEWS, f"""WITH {NAMES}, sd AS (
  SELECT g.meeting_id, idx, start_ms, end_ms, speaker, coalesce(name, speaker) AS name, text FROM segments_fx g LEFT JOIN nm ON nm.meeting_id = g.meeting_id AND nm.key = g.speaker
), sp AS (SELECT meeting_id, string_agg(speaker || '=' || name || '=' || ms, ',' ORDER BY ms DESC, speaker) AS who FROM (SELECT meeting_id, speaker, name, sum(end_ms - start_ms) AS ms FROM sd GROUP BY ALL) GROUP BY 1)
SELECT sd.meeting_id, any_value(title) AS title, any_value(who) AS speakers, string_agg(idx || ':' || speaker || ':' || start_ms || ':' || text, '|' ORDER BY idx) AS segments
FROM sd JOIN sp USING (meeting_id) JOIN meetings_fx m ON m.id = sd.meeting_id GROUP BY 1""")
def s12(segments, meeting_speakers, people, meetings):
    made = exports.export_json(segments, stats.speaker_names(meeting_speakers, people), _meetings(meetings))
    schema = "struct<title:string,speakers:array<struct<key:string,name:string,talk_ms:bigint>>,segments:array<struct<idx:bigint,start_ms:bigint,speaker:string,text:string>>>"
    read = made.selectExpr("meeting_id", f"from_json(text, '{schema}') AS d")
    return read.selectExpr(
        "meeting_id", "d.title", "array_join(transform(d.speakers, s -> concat(s.key, '=', s.name, '=', s.talk_ms)), ',') AS speakers",
        "array_join(transform(d.segments, s -> concat(s.idx, ':', s.speaker, ':', s.start_ms, ':', s.text)), '|') AS segments",
    )
