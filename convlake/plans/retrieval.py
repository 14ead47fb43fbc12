"""Registered queries of the word index and of contexts for questions (Q1-Q4, Q6, Q9, Q10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import search
from convlake.plans.conversations import PASSAGES, STOP_SQL, query

TOKENS = "tl AS MATERIALIZED (SELECT meeting_id, idx, regexp_extract_all(strip_accents(lower(text)), '[\\pL\\pN]+') AS ts FROM segments_fx)"


@query("q1_build_index", ("segments_fx",), f"""WITH {TOKENS} SELECT ts[i] AS token, meeting_id, idx, any_value(len(ts)) AS len, count(*) AS tf, min(i) - 1 AS first
FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM tl) GROUP BY 1, 2, 3""")
def q1(segments):
    return search.build_index(segments).selectExpr("token", "meeting_id", "idx", "len", "cast(size(places) AS bigint) AS tf", "places[0] AS first")


Q = "Qué en un"
SCORED = f"""{TOKENS}, q(term) AS (VALUES ('que'), ('en'), ('un')), tf AS (
  SELECT meeting_id, idx, len(ts) AS ln, term, len(list_filter(ts, lambda t: starts_with(t, term))) AS tf FROM tl, q
), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1), sz AS (SELECT count(*) AS n, sum(len(ts)) AS words FROM tl), hi AS (
  SELECT meeting_id, idx, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.000001) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * ln * n / words))), 6) AS score
  FROM tf JOIN df USING (term), sz WHERE tf > 0 GROUP BY 1, 2 HAVING count(*) = 3 ORDER BY score DESC, meeting_id, idx LIMIT 200
)"""


def _hits(segments):
    return search.search_index(search.build_index(segments), search.index_statistics(segments), Q)


@query("q2_search_index", ("segments_fx",), f"WITH {SCORED} SELECT * FROM hi")
def q2(segments):
    return _hits(segments)


@query("q3_snippet", ("segments_fx",), f"""WITH {SCORED}, sw AS (
  SELECT meeting_id, idx, score, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM hi JOIN segments_fx USING (meeting_id, idx)
), mk AS (SELECT *, list_transform(ws, lambda w: len(list_filter(regexp_extract_all(strip_accents(lower(w)), '[\\pL\\pN]+'), lambda t: starts_with(t, 'que') OR starts_with(t, 'en') OR starts_with(t, 'un'))) > 0) AS ms FROM sw
), st AS (SELECT meeting_id, idx, a, len(list_filter(ms[a + 1:a + 14], lambda m: m)) AS n FROM (SELECT *, unnest(range(0, greatest(0, len(ws) - 14) + 1)) AS a FROM mk)
), be AS (SELECT meeting_id, idx, min_by(a, {{'x': -n, 'a': a}}) AS a FROM st GROUP BY 1, 2)
SELECT meeting_id, idx, score, CASE WHEN a > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(a + 1, least(a + 14, len(ws)) + 1), lambda i: CASE WHEN ms[i] THEN '[[' || ws[i] || ']]' ELSE ws[i] END), ' ')
  || CASE WHEN a + 14 < len(ws) THEN '…' ELSE '' END AS snippet FROM mk JOIN be USING (meeting_id, idx)""")
def q3(segments):
    return search.snippets(_hits(segments), segments, Q)


@query("q4_group_hits", ("segments_fx", "meetings_fx"), f"""WITH {SCORED}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, meeting_id, idx) AS rank FROM hi
), g AS (SELECT meeting_id, min(rank) AS rank, string_agg(idx::VARCHAR, ',' ORDER BY rank) FILTER (WHERE place <= 5) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY rank) AS place FROM rk) GROUP BY 1)
SELECT meeting_id, title, coalesce(recorded_s, created_s) AS date_s, row_number() OVER (ORDER BY rank) AS place, hits FROM g JOIN meetings_fx m ON m.id = g.meeting_id""")
def q4(segments, meetings):
    dated = meetings.selectExpr("id", "title", "coalesce(recorded_s, created_s) AS date_s")
    return search.group_hits(_hits(segments), dated).withColumn("hits", F.array_join("hits", ","))


@query("q6_title_hits", ("segments_fx", "meetings_fx"), f"WITH {SCORED} SELECT id, title FROM meetings_fx WHERE contains(lower(title), 'die') AND id NOT IN (SELECT meeting_id FROM hi)")
def q6(segments, meetings):
    return search.title_hits(meetings, "DIE", _hits(segments))


PICKED = f"""{PASSAGES}, tk AS (
  SELECT meeting_id, "window", list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_'']+'), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL})) AS ts FROM ps
), a AS (SELECT meeting_id, count(*) AS n, avg(len(ts)) AS av FROM tk GROUP BY 1), q(term) AS (VALUES ('onre'), ('lepa'), ('mente')), tf AS (
  SELECT meeting_id, "window", len(ts)::DOUBLE AS ln, len(list_filter(ts, lambda x: x = term)) AS tf, term FROM tk, q
), df AS (SELECT meeting_id, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL), sc AS (
  SELECT tf.meeting_id, "window", round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / greatest(av, 1)))), 6) AS score
  FROM tf JOIN df USING (meeting_id, term) JOIN a USING (meeting_id) WHERE tf > 0 GROUP BY ALL
), wl AS (
  SELECT meeting_id, w AS "window", list({{'idx': idx, 'tokens': length(line) * 2 // 7 + 2}} ORDER BY idx) AS lines FROM (
    SELECT *, unnest(range(greatest(0, (idx - 6) // 6), idx // 6 + 1)) AS w FROM note_lines_fx) GROUP BY 1, 2
), od AS MATERIALIZED (
  SELECT wl.meeting_id, lines, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY wl.meeting_id ORDER BY coalesce(score, 0) DESC, wl."window") AS k FROM wl LEFT JOIN sc USING (meeting_id, "window")
), pk AS (
  SELECT meeting_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS picked FROM od WHERE k = 1
  UNION ALL
  SELECT meeting_id, k, CASE WHEN takes THEN used + cost ELSE used END::BIGINT, CASE WHEN takes THEN list_concat(picked, list_transform(fresh, lambda x: x.idx)) ELSE picked END FROM (
    SELECT *, used + cost <= 300 AND NOT (score <= 0 AND len(picked) > 0) AS takes FROM (
      SELECT *, coalesce(list_sum(list_transform(fresh, lambda x: x.tokens)), 0) AS cost FROM (
        SELECT o.meeting_id, o.k, o.score, used, picked, list_filter(lines, lambda x: NOT list_contains(picked, x.idx)) AS fresh FROM pk JOIN od o ON o.meeting_id = pk.meeting_id AND o.k = pk.k + 1)))
), pi AS (SELECT meeting_id, unnest(picked) AS idx FROM (SELECT meeting_id, arg_max(picked, k) AS picked FROM pk GROUP BY 1))"""


def _picked(lines):
    scores = search.bm25(search.passages(lines), ["onre", "lepa", "mente"])
    return search.select_context(scores.withColumn("score", F.round("score", 6)), lines, 300)


@query("q9_select_context", ("note_lines_fx",), f"WITH RECURSIVE {PICKED} SELECT * FROM pi")
def q9(lines):
    return _picked(lines)


@query("q10_ask_context", ("note_lines_fx",), f"""WITH RECURSIVE {PICKED}, ch AS (SELECT meeting_id, (sum(length(line) + 1) - 1) * 2 // 7 <= 300 AS whole FROM note_lines_fx GROUP BY 1)
SELECT meeting_id, whole, CASE WHEN whole THEN string_agg(line, chr(10) ORDER BY idx) ELSE string_agg(line, chr(10) || '...' || chr(10) ORDER BY idx) END AS context
FROM note_lines_fx l JOIN ch USING (meeting_id) WHERE whole OR EXISTS (SELECT 1 FROM pi WHERE pi.meeting_id = l.meeting_id AND pi.idx = l.idx) GROUP BY 1, 2""")
def q10(lines):
    return search.ask_context(lines, _picked(lines), 300)
