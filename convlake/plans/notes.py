"""Registered queries of notes as a map-reduce job."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import notes
from convlake.plans.conversations import KEY, LINES, NOTE_VIEWS, n1, query


@query("n4_chunk_lines", NOTE_VIEWS, f"""WITH RECURSIVE {LINES}, lc AS MATERIALIZED (
  SELECT meeting_id, idx, tokens, (length(line) * 2 // 7 + 2)::BIGINT AS carried, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS k FROM tk JOIN ln USING (meeting_id, idx)
), ck AS (
  SELECT meeting_id, idx, k, carried, 0::BIGINT AS part, tokens AS used, false AS fresh, NULL::BIGINT AS before FROM lc WHERE k = 1
  UNION ALL
  SELECT meeting_id, idx, k, carried, CASE WHEN new THEN part + 1 ELSE part END, CASE WHEN new THEN was + tokens ELSE used + tokens END, new, prior FROM (
    SELECT l.*, part, used, ck.carried AS was, ck.idx AS prior, used + l.tokens > 250 AS new FROM ck JOIN lc l ON l.meeting_id = ck.meeting_id AND l.k = ck.k + 1)
) SELECT meeting_id, part, idx FROM ck UNION ALL SELECT meeting_id, part, before FROM ck WHERE fresh""")
def n4(segments, meeting_speakers, people):
    lines = n1(segments, meeting_speakers, people)
    tokens = notes.line_tokens(lines).join(lines.selectExpr("meeting_id", "idx", "cast(length(line) * 2 div 7 + 2 AS bigint) AS carried"), ["meeting_id", "idx"])
    return notes.chunk_lines(tokens, 250)


@query("n5_pending_parts", ("segments_fx",), """WITH p AS (SELECT meeting_id, idx AS part, sha1('local' || chr(10) || 'm1' || chr(10) || text) AS key FROM segments_fx), c AS (
  SELECT meeting_id, key FROM p WHERE part % 2 = 0 AND part <> 4 QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY part DESC, key) <= 60
) SELECT * FROM p WHERE (meeting_id, key) NOT IN (SELECT (meeting_id, key) FROM c)""")
def n5(segments):
    parts = segments.selectExpr("meeting_id", "idx AS part", "text AS prompt")
    cache = segments.where("idx % 2 = 0").selectExpr("meeting_id", "sha1(concat_ws('\\n', 'local', 'm1', text)) AS key", "idx AS seq", "idx = 4 AS cut")
    return notes.pending_parts(parts, cache, "local", "m1")[0].select("meeting_id", "part", "key")


# Chapters derived from lines: a time that repeats, titles that repeat, some without.
CHAPTERS = """ch AS (SELECT l.meeting_id, idx, idx // 2 * 4 AS t, regexp_replace(CASE WHEN idx % 5 = 4 THEN '' ELSE left(line, 6) END, '^\\s+|\\s+$', '', 'g') AS title, n_chars // 10 AS duration_s FROM note_lines_fx l JOIN documents d ON d.doc_id = l.meeting_id)"""


def _chapters(lines, documents):
    rows = lines.join(documents.selectExpr("doc_id AS meeting_id", "cast(n_chars div 10 AS bigint) AS duration_s"), "meeting_id")
    rows = rows.selectExpr("meeting_id", "idx", "idx div 2 * 4 AS s", "if(idx % 5 = 4, '', left(line, 6)) AS title", "'' AS summary", "duration_s")
    return rows.withColumn("time", F.expr("concat_ws(':', lpad(s div 3600, 2, '0'), lpad(s div 60 % 60, 2, '0'), lpad(s % 60, 2, '0'))"))


@query("n10_clean_chapters", ("note_lines_fx", "documents"), f"""WITH RECURSIVE {CHAPTERS}, co AS MATERIALIZED (
  SELECT *, {KEY.format(x='title')} AS key, row_number() OVER (PARTITION BY meeting_id ORDER BY t, idx) AS k FROM ch WHERE title <> '' AND t <= duration_s + 5
), cr AS (
  SELECT meeting_id, k, t, title, key, t AS lt, key AS lk, true AS kept FROM co WHERE k = 1
  UNION ALL
  SELECT o.meeting_id, o.k, o.t, o.title, o.key, CASE WHEN o.t - lt < 5 OR o.key = lk THEN lt ELSE o.t END, CASE WHEN o.t - lt < 5 OR o.key = lk THEN lk ELSE o.key END, NOT (o.t - lt < 5 OR o.key = lk)
  FROM cr JOIN co o ON o.meeting_id = cr.meeting_id AND o.k = cr.k + 1
) SELECT meeting_id, t, title, '' AS summary FROM cr WHERE kept""")
def n10(lines, documents):
    return notes.clean_chapters(_chapters(lines, documents))


@query("n12_clean_sections", ("note_lines_fx",), f"""WITH k AS (SELECT meeting_id, idx % 4 AS section, idx, regexp_replace(trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '-•* '), '^\\s+|\\s+$', '', 'g') AS item FROM note_lines_fx WHERE idx % 4 <> 3), f AS (
  SELECT * FROM k WHERE {KEY.format(x='item')} <> '' QUALIFY row_number() OVER (PARTITION BY meeting_id, section, {KEY.format(x='item')} ORDER BY idx) = 1
) SELECT meeting_id, section, 'Part ' || section AS title, string_agg(item, '|' ORDER BY idx) AS items FROM f GROUP BY 1, 2""")
def n12(lines):
    rows = lines.selectExpr("meeting_id", "idx % 4 AS section", "if(idx % 4 = 3, '', concat('Part ', idx % 4)) AS title", "idx", "line AS item")
    return notes.clean_sections(rows).withColumn("items", F.array_join("items", "|"))


@query("n12_clean_record", ("note_lines_fx",), f"""WITH k AS (SELECT meeting_id, idx % 3 AS kind, idx, regexp_replace(trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '-•* '), '^\\s+|\\s+$', '', 'g') AS item FROM note_lines_fx), f AS (
  SELECT * FROM k WHERE {KEY.format(x='item')} <> '' QUALIFY row_number() OVER (PARTITION BY meeting_id, kind, {KEY.format(x='item')} ORDER BY idx) = 1
), t AS (SELECT meeting_id, coalesce(arg_min(line, idx), '') AS line FROM note_lines_fx GROUP BY 1)
SELECT t.meeting_id, left(regexp_replace(trim('"' || any_value(line) || '"', '"'), '^\\s+|\\s+$', '', 'g'), 120) AS title, regexp_replace(any_value(line), '^\\s+|\\s+$', '', 'g') AS summary,
  coalesce(string_agg(item, '|' ORDER BY idx) FILTER (WHERE kind = 0), '') AS key_points, coalesce(string_agg(item, '|' ORDER BY idx) FILTER (WHERE kind = 1), '') AS decisions, coalesce(string_agg(item, '|' ORDER BY idx) FILTER (WHERE kind = 2), '') AS open_questions
FROM t LEFT JOIN f USING (meeting_id) GROUP BY 1""")
def n12_record(lines):
    told = [F.expr(f"transform(array_sort(collect_list(if(idx % 3 = {k}, struct(idx, line), NULL))), x -> x.line)").alias(n) for k, n in enumerate(("key_points", "decisions", "open_questions"))]
    rows = lines.groupBy("meeting_id").agg(F.expr("min_by(line, idx)").alias("line"), *told)
    rows = rows.selectExpr("meeting_id", "concat(' \"', line, '\" ') AS title", "concat(line, ' \t') AS summary", "key_points", "decisions", "open_questions")
    made = notes.clean_record(rows)
    return made.withColumns({n: F.array_join(n, "|") for n in ("key_points", "decisions", "open_questions")})


PICKS = "n <= 4 OR place IN (SELECT round_even(i * (n - 1) / 3.0::DOUBLE, 0) FROM range(0, 4) r(i))"
TOPICS = f"""{CHAPTERS}, tp AS (
  SELECT meeting_id, t, title, duration_s, row_number() OVER (PARTITION BY meeting_id ORDER BY t, idx) - 1 AS place, count(*) OVER (PARTITION BY meeting_id) AS n FROM ch WHERE title <> '' AND t < duration_s - 60
), pt AS (SELECT meeting_id, t, title, duration_s FROM tp WHERE {PICKS})"""


def _topics(lines, documents):
    return notes.chapters_from_topics(_chapters(lines, documents).selectExpr("meeting_id", "0 AS part", "idx", "time", "title", "4 AS most", "duration_s - 60 AS until_s"))


@query("n13_chapters_from_topics", ("note_lines_fx", "documents"), f"WITH {TOPICS} SELECT meeting_id, t, title FROM pt")
def n13(lines, documents):
    return _topics(lines, documents)


@query("n14_meeting_chapters", ("note_lines_fx", "documents"), f"""WITH {TOPICS}, fi AS (SELECT meeting_id, idx, t * 3 AS t, 'Final ' || idx AS title, CASE idx % 3 WHEN 0 THEN '' ELSE 'About ' || idx END AS summary, duration_s FROM ch WHERE idx < 6
), us AS (SELECT DISTINCT meeting_id FROM pt WHERE meeting_id NOT IN (SELECT meeting_id FROM fi WHERE t >= 0.6 * duration_s))
SELECT meeting_id, t, title, summary FROM fi WHERE meeting_id NOT IN (SELECT meeting_id FROM us)
UNION ALL SELECT DISTINCT meeting_id, t, title, coalesce((SELECT arg_min(summary, idx) FROM fi WHERE fi.meeting_id = pt.meeting_id AND summary <> '' AND abs(fi.t - pt.t) <= 90), '') FROM pt WHERE meeting_id IN (SELECT meeting_id FROM us)""")
def n14(lines, documents):
    final = _chapters(lines, documents).where("idx < 6").selectExpr("meeting_id", "idx", "s * 3 AS t", "concat('Final ', idx) AS title", "if(idx % 3 = 0, '', concat('About ', idx)) AS summary", "duration_s")
    return notes.meeting_chapters(final, _topics(lines, documents))


@query("n15_condense_groups", ("segments_fx",), """WITH RECURSIVE st AS (
  SELECT *, sum(tokens) OVER (PARTITION BY meeting_id) AS whole, count(*) OVER (PARTITION BY meeting_id) AS n, row_number() OVER (PARTITION BY meeting_id ORDER BY part) AS k
  FROM (SELECT meeting_id, idx AS part, length(text) // 4 AS tokens FROM segments_fx)
), big AS MATERIALIZED (SELECT * FROM st WHERE whole > 400 AND n > 1), pk AS (
  SELECT meeting_id, part, k, 0::BIGINT AS g, tokens AS used FROM big WHERE k = 1
  UNION ALL
  SELECT b.meeting_id, b.part, b.k, CASE WHEN used + b.tokens > 320 THEN g + 1 ELSE g END, CASE WHEN used + b.tokens > 320 THEN b.tokens ELSE used + b.tokens END
  FROM pk JOIN big b ON b.meeting_id = pk.meeting_id AND b.k = pk.k + 1
) SELECT meeting_id, part, CASE WHEN max(g) OVER (PARTITION BY meeting_id) + 1 = count(*) OVER (PARTITION BY meeting_id) THEN (k - 1) // 2 ELSE g END AS "group" FROM pk""")
def n15(segments):
    return notes.condense_groups(segments.selectExpr("meeting_id", "idx AS part", "cast(length(text) div 4 AS bigint) AS tokens"), 400)
