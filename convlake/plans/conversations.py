"""The registered queries of the conversation operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.fixtures import load, with_views
from convlake.functions.columns import note_key, parse_time, subtitle_time
from convlake.operators import align, diarize, notes, recordings, search, speakers, stats
from convlake.sources.names import export_name, title_from_filename

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, views: tuple[str, ...], sql: str | None):
    """Registers a function of the named views as a query, with its SQL over the same views where SQL can express it."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*[load(spark, sf_dir, v) for v in views])
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn

    return register


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


RUNS = """r AS (
  SELECT *, sum(change) OVER (PARTITION BY meeting_id ORDER BY idx) AS run FROM (
    SELECT *, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words,
           CASE WHEN speaker = lag(speaker) OVER (PARTITION BY meeting_id ORDER BY idx) THEN 0 ELSE 1 END AS change FROM segments_fx)
), u AS (
  SELECT meeting_id, speaker, run, sum(words) AS words, sum(end_ms - start_ms) AS talk, arg_max(end_ms, idx) - arg_min(start_ms, idx) AS long FROM r GROUP BY ALL
), st AS (
  SELECT meeting_id, speaker, count(*) AS turns, sum(words)::BIGINT AS words, sum(talk)::BIGINT AS talk_ms, max(long) AS longest_ms FROM u GROUP BY ALL
)"""


@query("m1_speaker_stats", ("segments_fx", "meeting_speakers_fx"), f"WITH {RUNS} SELECT * FROM st UNION ALL SELECT DISTINCT meeting_id, 'S9', 0, 0, 0, 0 FROM meeting_speakers_fx WHERE meeting_id % 3 = 0")
def m1(segments, meeting_speakers):
    silent = meeting_speakers.where("meeting_id % 3 = 0").selectExpr("meeting_id", "'S9' AS key")
    return stats.speaker_stats(segments, meeting_speakers.select("meeting_id", "key").unionByName(silent))


@query("m2_talk_share", ("segments_fx",), f"WITH {RUNS} SELECT meeting_id, speaker, CASE WHEN sum(talk_ms) OVER (PARTITION BY meeting_id) = 0 THEN 0 ELSE floor(100.0 * talk_ms / sum(talk_ms) OVER (PARTITION BY meeting_id) + 0.5)::BIGINT END AS share FROM st")
def m2(segments):
    return stats.talk_share(stats.speaker_stats(segments))


@query("m3_meeting_stats", ("segments_fx",), f"""WITH {RUNS} SELECT meeting_id, sum(turns)::BIGINT AS turns, sum(words)::BIGINT AS words,
  floor(sum(words) / greatest(1.0::DOUBLE, sum(talk_ms)::DOUBLE / 60000) + 0.5)::BIGINT AS words_per_minute, max(longest_ms) AS longest_ms,
  first(speaker ORDER BY longest_ms DESC, speaker) AS longest_speaker FROM st GROUP BY meeting_id""")
def m3(segments):
    return stats.meeting_stats(stats.speaker_stats(segments))


@query("m4_longest_segment", ("segments_fx",), """SELECT meeting_id, speaker, idx, end_ms - start_ms AS ms FROM segments_fx
  QUALIFY row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY end_ms - start_ms DESC, idx) = 1""")
def m4(segments):
    return stats.longest_segment(segments)


@query("m5_perf_ema", ("perf_fx",), """WITH v AS (SELECT key, list(value::DOUBLE ORDER BY seq) AS vs FROM perf_fx WHERE seq * 13 % 100 > 60 GROUP BY key)
SELECT key, round(list_reduce(list_transform(range(1, len(vs) + 1), lambda i: {'x': vs[i], 'n': i}),
  lambda s, o: {'x': s.x + CASE WHEN s.n < 3 THEN 0.5 ELSE 0.3 END * (o.x - s.x), 'n': o.n}).x, 6) AS value, len(vs)::BIGINT AS samples FROM v""")
def m5(observations):
    return rounded(stats.perf_ema(stats.observed(observations.withColumn("duration_s", F.expr("seq * 13 % 100"))), 64), "value")


@query("m7_meeting_totals", ("segments_fx", "samples_fx"), """WITH t AS (
  SELECT meeting_id, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words, count(*) AS segments, sum(end_ms - start_ms)::BIGINT AS speech_ms FROM segments_fx GROUP BY 1
), l AS (SELECT meeting_id, count(*) AS learned FROM samples_fx GROUP BY 1)
SELECT t.*, coalesce(learned, 0) AS learned FROM t LEFT JOIN l USING (meeting_id)""")
def m7(segments, samples):
    return stats.meeting_totals(segments, samples)


@query("p1_speaker_names", ("meeting_speakers_fx", "speakers_fx"), """SELECT meeting_id, key, coalesce(nullif(name, ''), nullif(label, ''), key) AS name
  FROM meeting_speakers_fx m LEFT JOIN speakers_fx s ON s.id = m.speaker_id""")
def p1(meeting_speakers, people):
    return stats.speaker_names(meeting_speakers, people)


@query("p1_speaker_rows", ("meeting_speakers_fx", "speakers_fx"), """SELECT meeting_id, key, substr(key, 2)::BIGINT AS number, coalesce(nullif(s.name, ''), nullif(label, ''), key) AS name, status, g.name AS suggested_name
  FROM meeting_speakers_fx m LEFT JOIN speakers_fx s ON s.id = m.speaker_id LEFT JOIN speakers_fx g ON g.id = talk_ms % 12""")
def p1_rows(meeting_speakers, people):
    return stats.speaker_rows(meeting_speakers.withColumn("suggested_id", F.expr("talk_ms % 12")), people)


@query("p7_bookmarks", ("segments_fx", "turns_fx"), """WITH b AS (SELECT meeting_id, start_ms AS at_ms FROM turns_fx)
SELECT b.meeting_id, b.at_ms, (SELECT min(idx) FROM segments_fx s WHERE s.meeting_id = b.meeting_id AND s.start_ms >= b.at_ms) AS idx FROM b
WHERE EXISTS (SELECT 1 FROM segments_fx s WHERE s.meeting_id = b.meeting_id AND s.start_ms >= b.at_ms)""")
def p7(segments, turns):
    return stats.place_bookmarks(segments, turns.selectExpr("meeting_id", "start_ms AS at_ms"))


@query("p8_chapter_at", ("segments_fx", "turns_fx"), """WITH c AS (SELECT meeting_id, start_ms, 'Part ' || idx AS title FROM segments_fx WHERE speaker = 'S1')
SELECT t.meeting_id, t.start_ms AS at_ms, c.title FROM turns_fx t ASOF LEFT JOIN c ON c.meeting_id = t.meeting_id AND c.start_ms <= t.start_ms""")
def p8(segments, turns):
    chapters = segments.where("speaker = 'S1'").selectExpr("meeting_id", "start_ms", "concat('Part ', idx) AS title")
    return stats.chapter_at(chapters, turns.selectExpr("meeting_id", "start_ms AS at_ms"))


FLAT = "f AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, idx, pos) AS n, text, start_ms, greatest(start_ms, end_ms) AS end_ms FROM words_fx)"
ASSIGNED = f"""{FLAT}, k AS (
  SELECT meeting_id, speaker, start_ms AS ts, end_ms AS te, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, speaker) AS k FROM turns_fx
), w AS (SELECT meeting_id, n, start_ms AS ws, greatest(end_ms, start_ms + 20) AS we FROM f), i AS (
  SELECT w.*, coalesce(k.k, 0) AS i FROM w ASOF LEFT JOIN (SELECT meeting_id, ts, max(k) AS k FROM k GROUP BY ALL) k ON k.meeting_id = w.meeting_id AND k.ts <= w.we
), m AS (
  SELECT i.*, k.k, speaker, CASE WHEN k.k <= i THEN least(we, te) - greatest(ws, ts) ELSE 0 END AS ov,
         CASE WHEN k.k = i THEN abs((ws + we) / 2.0 - te) WHEN k.k = i + 1 THEN abs(ts - (ws + we) / 2.0) END AS d
  FROM i LEFT JOIN k ON k.meeting_id = i.meeting_id AND k.k BETWEEN i - 11 AND i + 1
), a AS (
  SELECT meeting_id, n, coalesce(first(speaker ORDER BY ov DESC, k DESC) FILTER (WHERE ov > 0), first(speaker ORDER BY d, speaker) FILTER (WHERE d < 2000)) AS speaker FROM m GROUP BY ALL
)"""


@query("t1_flatten_words", ("words_fx",), f"WITH {FLAT} SELECT * FROM f")
def t1(words):
    return align.flatten_words(words)


@query("t2_assign_speakers", ("words_fx", "turns_fx"), f"WITH {ASSIGNED} SELECT * FROM a")
def t2(words, turns):
    return align.assign_speakers(align.flatten_words(words), turns)


@query("t4_fill_gaps", ("words_fx", "turns_fx"), f"""WITH {ASSIGNED} SELECT meeting_id, n, coalesce(
  last_value(speaker IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY n ROWS UNBOUNDED PRECEDING),
  first_value(speaker IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM a""")
def t4(words, turns):
    return align.fill_gaps(align.assign_speakers(align.flatten_words(words), turns))


SUMS = """v AS (
  SELECT id, speaker_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM samples_fx WHERE model = 'cur'
), e AS (SELECT speaker_id, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM v), s AS (
  SELECT speaker_id, max(n) AS n, list(x ORDER BY dim) AS total FROM (SELECT speaker_id, dim, sum(x) AS x, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1
)"""


@query("l1_profiles", ("samples_fx",), f"WITH {SUMS} SELECT speaker_id, n, round(total[1] / sqrt(list_dot_product(total, total)), 6) AS first, round(total[64] / sqrt(list_dot_product(total, total)), 6) AS last FROM s")
def l1(samples):
    return speakers.profiles(samples).selectExpr("speaker_id", "n", "round(centroid[0], 6) AS first", "round(centroid[63], 6) AS last")


@query("l2_library_stats", ("speakers_fx", "samples_fx", "meeting_speakers_fx"), """SELECT s.id AS speaker_id, name, count(x.id) AS samples, coalesce(sum(end_ms - start_ms), 0)::BIGINT AS ms,
  count(*) FILTER (WHERE model = 'cur') AS "current", (SELECT count(DISTINCT meeting_id) FROM meeting_speakers_fx m WHERE m.speaker_id = s.id) AS meetings FROM speakers_fx s LEFT JOIN samples_fx x ON x.speaker_id = s.id GROUP BY 1, 2""")
def l2(people, samples, meeting_speakers):
    return speakers.library_stats(people, samples, meeting_speakers)


@query("l3_consistency", ("samples_fx",), f"WITH {SUMS} SELECT speaker_id, CASE WHEN n >= 2 THEN round((list_dot_product(total, total) - n) / (n * (n - 1)), 6) END AS consistency FROM s")
def l3(samples):
    return rounded(speakers.consistency(samples), "consistency")


@query("l4_strength", ("speakers_fx", "samples_fx", "meeting_speakers_fx"), f"""WITH {SUMS}, c AS (SELECT speaker_id, CASE WHEN n >= 2 THEN (list_dot_product(total, total) - n) / (n * (n - 1)) END AS c FROM s), t AS (
  SELECT p.id AS speaker_id, coalesce(sum(end_ms - start_ms), 0) AS ms, count(*) FILTER (WHERE model = 'cur') AS cur FROM speakers_fx p LEFT JOIN samples_fx x ON x.speaker_id = p.id GROUP BY 1
) SELECT t.speaker_id, CASE WHEN cur = 0 THEN 'none' WHEN cur < 3 OR ms < 15000 THEN 'weak' WHEN cur >= 8 AND ms >= 60000 AND (c IS NULL OR c > 0.45) THEN 'strong' ELSE 'good' END AS strength FROM t LEFT JOIN c USING (speaker_id)""")
def l4(people, samples, meeting_speakers):
    return speakers.strength(speakers.library_stats(people, samples, meeting_speakers), speakers.consistency(samples))


@query("l5_sample_details", ("samples_fx", "meetings_fx"), f"""WITH {SUMS}, o AS (
  SELECT v.id, list_dot_product(v, total) - 1 AS dot, list_dot_product(total, total) - 2 * list_dot_product(v, total) + 1 AS rest FROM v JOIN s USING (speaker_id) WHERE n >= 3
) SELECT x.id, x.speaker_id, x.meeting_id, m.title, x.model = 'cur' AS active, round(dot / sqrt(rest), 6) AS score, coalesce(dot / sqrt(rest) < 0.48, false) AS outlier
  FROM samples_fx x LEFT JOIN o ON o.id = x.id LEFT JOIN meetings_fx m ON m.id = x.meeting_id""")
def l5(samples, meetings):
    return rounded(speakers.sample_details(samples, meetings), "score")


@query("l15_reembed_worklist", ("samples_fx",), """WITH c AS (SELECT id, speaker_id % 3 AS speaker_id, model, CASE WHEN id % 4 > 0 THEN 'clip' || (id // 3) END AS clip FROM samples_fx)
SELECT speaker_id, clip, min(id) AS id FROM c o WHERE model <> 'cur' AND clip IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.model = 'cur' AND c.speaker_id = o.speaker_id AND c.clip = o.clip) GROUP BY 1, 2""")
def l15(samples):
    return speakers.reembed_worklist(samples.selectExpr("id", "speaker_id % 3 AS speaker_id", "model", "if(id % 4 > 0, concat('clip', id div 3), NULL) AS clip"), "cur")


@query("l18_merge_speakers", ("samples_fx", "meeting_speakers_fx", "speakers_fx"), """SELECT 'sample' AS kind, id::VARCHAR AS name, CASE WHEN speaker_id >= 5 THEN speaker_id - 5 ELSE speaker_id END AS speaker_id, NULL::BIGINT AS suggested_id FROM samples_fx
UNION ALL SELECT 'match', meeting_id || key, CASE WHEN speaker_id >= 5 THEN speaker_id - 5 ELSE speaker_id END, CASE WHEN talk_ms % 12 BETWEEN 5 AND 9 THEN talk_ms % 12 - 5 ELSE talk_ms % 12 END FROM meeting_speakers_fx
UNION ALL SELECT 'person', name, id, NULL FROM speakers_fx WHERE id < 5""")
def l18(samples, meeting_speakers, people):
    mapping = people.where("id BETWEEN 5 AND 9").selectExpr("id AS source", "id - 5 AS target")
    own, matched, left = speakers.merge_speakers(samples, meeting_speakers.withColumn("suggested_id", F.expr("talk_ms % 12")), people, mapping)
    none = "cast(NULL AS bigint) AS suggested_id"
    rows = own.selectExpr("'sample' AS kind", "cast(id AS string) AS name", "speaker_id", none).unionByName(matched.selectExpr("'match' AS kind", "concat(meeting_id, key) AS name", "speaker_id", "suggested_id"))
    return rows.unionByName(left.selectExpr("'person' AS kind", "name", "id AS speaker_id", none))


@query("l20_merge_meeting_keys", ("meeting_speakers_fx", "segments_fx", "turns_fx"), """SELECT 'speaker' AS kind, meeting_id, CASE key WHEN 'S3' THEN 'S1' ELSE key END AS key, sum(talk_ms)::BIGINT AS at FROM meeting_speakers_fx GROUP BY ALL
UNION ALL SELECT 'segment', meeting_id, CASE speaker WHEN 'S3' THEN 'S1' ELSE speaker END, idx FROM segments_fx
UNION ALL SELECT 'turn', meeting_id, CASE speaker WHEN 'S3' THEN 'S1' ELSE speaker END, start_ms FROM turns_fx""")
def l20(meeting_speakers, segments, turns):
    mapping = meeting_speakers.where("key = 'S3'").selectExpr("meeting_id", "key AS source", "'S1' AS target")
    talk, said, spoken = speakers.merge_meeting_keys(meeting_speakers, segments, turns, mapping)
    rows = talk.selectExpr("'speaker' AS kind", "meeting_id", "key", "talk_ms AS at").unionByName(said.selectExpr("'segment' AS kind", "meeting_id", "speaker AS key", "idx AS at"))
    return rows.unionByName(spoken.selectExpr("'turn' AS kind", "meeting_id", "speaker AS key", "start_ms AS at"))


@query("l24_spread_names", ("speakers_fx", "meeting_speakers_fx"), """SELECT 'person' AS kind, id::VARCHAR AS at, CASE WHEN id % 2 = 0 THEN 'Guest ' || id ELSE name END AS name, CASE WHEN id % 3 = 0 THEN '#00ff0' || id % 10 ELSE 'old' END AS color, 'About ' || id AS notes FROM speakers_fx
UNION ALL SELECT 'match', meeting_id || key, CASE WHEN speaker_id % 2 = 0 THEN 'Guest ' || speaker_id ELSE label END, CASE WHEN speaker_id % 3 = 0 THEN '#00ff0' || speaker_id % 10 ELSE 'old' END, NULL FROM meeting_speakers_fx""")
def l24_spread(people, meeting_speakers):
    changes = people.selectExpr("id", "if(id % 2 = 0, concat(' Guest ', id), concat('PERSON ', id - 1)) AS name", "if(id % 3 = 0, concat('#00ff0', id % 10), 'green') AS color", "concat('About ', id) AS notes")
    told, rows = speakers.spread_names(people.selectExpr("id", "name", "'old' AS color", "'' AS notes"), meeting_speakers.withColumn("color", F.lit("old")), changes)
    out = told.selectExpr("'person' AS kind", "cast(id AS string) AS at", "name", "color", "notes")
    return out.unionByName(rows.selectExpr("'match' AS kind", "concat(meeting_id, key) AS at", "label AS name", "color", "cast(NULL AS string) AS notes"))


LINES = """names AS (SELECT meeting_id, key AS speaker, coalesce(nullif(name, ''), nullif(label, ''), key) AS who FROM meeting_speakers_fx m LEFT JOIN speakers_fx s ON s.id = m.speaker_id), ln AS (
  SELECT g.meeting_id, idx, '[' || lpad((start_ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '] ' || coalesce(who, g.speaker) || ': ' || text AS line
  FROM segments_fx g LEFT JOIN names USING (meeting_id, speaker)
), tk AS (SELECT meeting_id, idx, (CASE WHEN length(line) > 400 THEN length(line) * 5 // 18 + 1 ELSE length(line) * 2 // 7 + 2 END)::BIGINT AS tokens FROM ln)"""
NOTE_VIEWS = ("segments_fx", "meeting_speakers_fx", "speakers_fx")


@query("n1_transcript_lines", NOTE_VIEWS, f"WITH {LINES} SELECT * FROM ln")
def n1(segments, meeting_speakers, people):
    return notes.transcript_lines(segments, stats.speaker_names(meeting_speakers, people))


@query("n2_line_tokens", NOTE_VIEWS, f"WITH {LINES} SELECT * FROM tk")
def n2(segments, meeting_speakers, people):
    return notes.line_tokens(n1(segments, meeting_speakers, people))


@query("n3_plan_parts", NOTE_VIEWS, f"""WITH {LINES}, s AS (SELECT meeting_id, sum(tokens)::BIGINT AS total FROM tk GROUP BY 1), p AS (
  SELECT *, CASE WHEN total <= 150 THEN 1 ELSE greatest(2, (total + 149) // 150) END::BIGINT AS parts FROM s
) SELECT *, CASE WHEN parts = 1 THEN 150 ELSE total * 108 // (parts * 100) + 200 END::BIGINT AS part_budget FROM p""")
def n3(segments, meeting_speakers, people):
    return notes.plan_parts(n2(segments, meeting_speakers, people), 150)


@query("n8_dedupe_items", ("note_lines_fx",), """WITH k AS (SELECT meeting_id, idx, regexp_replace(trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '-•* '), '^\\s+|\\s+$', '', 'g') AS item FROM note_lines_fx)
SELECT meeting_id, idx, item FROM k WHERE trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g')) <> ''
QUALIFY row_number() OVER (PARTITION BY meeting_id, trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g')) ORDER BY idx) = 1""")
def n8(lines):
    return notes.dedupe_items(lines)


@query("n11_parse_time", NOTE_VIEWS, f"WITH {LINES} SELECT meeting_id, idx, start_ms // 1000 AS seconds FROM ln JOIN segments_fx USING (meeting_id, idx)")
def n11(segments, meeting_speakers, people):
    return n1(segments, meeting_speakers, people).select("meeting_id", "idx", parse_time("line").alias("seconds"))


@query("n16_summary_line", ("documents",), "SELECT doc_id AS meeting_id, left((string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)))[1], 300) AS summary FROM documents")
def n16(documents):
    return notes.summary_line(documents.selectExpr("doc_id AS meeting_id", "text"))


@query("d1_sliding_windows", ("audio_fx",), """WITH r AS (SELECT meeting_id, count(*) AS samples FROM audio_fx GROUP BY 1), w AS (
  SELECT *, CASE WHEN samples < 20 THEN 0 ELSE (samples - 20) // 4 + 1 END AS whole FROM r
) SELECT meeting_id, c AS chunk, c * 4 AS start FROM (
  SELECT meeting_id, unnest(range(0, whole + CASE WHEN whole = 0 OR (whole > 0 AND (whole - 1) * 4 + 20 < samples) THEN 1 ELSE 0 END)) AS c FROM w)""")
def d1(audio):
    return diarize.sliding_windows(audio.groupBy("meeting_id").agg(F.count("*").alias("samples")), 20, 4)


FRAMES = "fr AS (SELECT meeting_id, speaker, unnest(range(start_ms // 100, end_ms // 100 + 1)) AS frame FROM turns_fx WHERE end_ms >= start_ms)"
TURNS9 = f"""{FRAMES}, di AS (SELECT DISTINCT * FROM fr), g AS (
  SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY meeting_id, speaker ORDER BY frame) - 1 <= 5 THEN 0 ELSE 1 END AS st FROM di
), sp AS (SELECT *, sum(st) OVER (PARTITION BY meeting_id, speaker ORDER BY frame) AS span FROM g), tu AS (
  SELECT meeting_id, speaker, min(frame) AS first, max(frame) AS last FROM sp GROUP BY meeting_id, speaker, span HAVING max(frame) - min(frame) + 1 >= 6
)"""


def _frames(turns):
    return turns.where("end_ms >= start_ms").selectExpr("meeting_id", "speaker", "explode(sequence(start_ms div 100, end_ms div 100)) AS frame")


@query("d9_frames_to_turns", ("turns_fx",), f"WITH {TURNS9} SELECT *, round(greatest(0, first * 270 / 16000::DOUBLE + 991 / 32000::DOUBLE - 270 / 32000::DOUBLE), 3) AS start_s, round((last + 1) * 270 / 16000::DOUBLE + 991 / 32000::DOUBLE - 270 / 32000::DOUBLE, 3) AS end_s FROM tu")
def d9(turns):
    return diarize.frames_to_turns(_frames(turns))


@query("d11_order_speakers", ("turns_fx",), f"WITH {TURNS9} SELECT meeting_id, speaker, row_number() OVER (PARTITION BY meeting_id ORDER BY min(first), speaker) AS number FROM tu GROUP BY meeting_id, speaker")
def d11(turns):
    return diarize.order_speakers(d9(turns))


@query("d13_waveform_peaks", ("audio_fx",), """WITH p AS (SELECT meeting_id, idx // 10 AS bucket, max(abs(value)) AS peak FROM audio_fx GROUP BY ALL), s AS (
  SELECT meeting_id, quantile_cont(peak, 0.995) AS scale FROM p GROUP BY 1
) SELECT meeting_id, bucket, CASE WHEN scale > 0 THEN round_even(100 * least(1.0, pow(peak / scale, 0.7)), 0)::BIGINT ELSE 0 END AS level FROM p JOIN s USING (meeting_id)""")
def d13(audio):
    return diarize.waveform_peaks(audio, 10)


@query("d13_loudness", ("audio_fx",), "SELECT meeting_id, count(*) / 10.0::DOUBLE AS duration_s, round(sqrt(avg(pow(greatest(-1, least(1, value / 100)), 2))), 6) AS rms FROM audio_fx GROUP BY 1")
def d13_loudness(audio):
    return rounded(diarize.loudness(audio.withColumn("value", F.expr("value / 100")), 10), "rms")


@query("q5_search_like", ("segments_fx",), "SELECT meeting_id, idx FROM segments_fx WHERE contains(lower(text), 'that') ORDER BY 1, 2 LIMIT 200")
def q5(segments):
    return search.search_like(segments, "That")


PASSAGES = """ps AS (
  SELECT meeting_id, w AS "window", min(idx) AS first, max(idx) AS last, string_agg(line, chr(10) ORDER BY idx) AS text FROM (
    SELECT *, unnest(range(greatest(0, (idx - 6) // 6), idx // 6 + 1)) AS w FROM note_lines_fx) GROUP BY 1, 2
)"""


@query("q7_passages", ("note_lines_fx",), f"WITH {PASSAGES} SELECT * FROM ps")
def q7(lines):
    return search.passages(lines)


STOP_SQL = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


@query("q8_bm25", ("note_lines_fx",), f"""WITH {PASSAGES}, tk AS (
  SELECT meeting_id, "window", list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_'']+'), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL})) AS ts FROM ps
), a AS (SELECT meeting_id, count(*) AS n, avg(len(ts)) AS av FROM tk GROUP BY 1), q(term, times) AS (VALUES ('onre', 2), ('lepa', 1), ('mente', 1)), tf AS (
  SELECT meeting_id, "window", len(ts)::DOUBLE AS ln, term, times, len(list_filter(ts, lambda x: x = term)) AS tf FROM tk, q
), df AS (SELECT meeting_id, term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL)
SELECT tf.meeting_id, "window", round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / greatest(av, 1)))), 6) AS score
FROM tf JOIN df USING (meeting_id, term) JOIN a USING (meeting_id) WHERE tf > 0 GROUP BY ALL""")
def q8(lines):
    return rounded(search.bm25(search.passages(lines), search.question_terms("Onre the lepa, onre mente?")), "score")


CUE = "lpad(({t} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({t} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({t} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({t} % 1000)::VARCHAR, 3, '0')"


@query("s11_subtitle_lines", ("segments_fx",), f"""SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS number,
  {CUE.format(t='start_ms')} || ' --> ' || {CUE.format(t='greatest(end_ms, start_ms + 300)')} AS times, speaker || ': ' || text AS text FROM segments_fx""")
def s11(segments):
    return segments.select(
        "meeting_id", F.expr("cast(row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS bigint)").alias("number"),
        F.concat(subtitle_time("start_ms"), F.lit(" --> "), subtitle_time("greatest(end_ms, start_ms + 300)")).alias("times"),
        F.concat("speaker", F.lit(": "), "text").alias("text"),
    )


@query("r2_unfinished_recordings", ("chunks_fx",), """WITH l AS (SELECT rid, max(ts) AS last, min(ts) AS first, sum(n_bytes)::BIGINT AS bytes FROM chunks_fx GROUP BY 1)
SELECT rid, bytes, floor(epoch(first))::BIGINT AS first_s, floor(epoch(last))::BIGINT AS last_s FROM l WHERE last <= (SELECT max(last) FROM l) - INTERVAL 6 HOUR""")
def r2(chunks):
    now = chunks.agg(F.max("ts")).first()[0]
    return recordings.unfinished(chunks, now, "6 HOURS").selectExpr("rid", "bytes", "unix_timestamp(cast(first AS timestamp)) AS first_s", "unix_timestamp(cast(last AS timestamp)) AS last_s")


@query("d12_speaking_time", ("turns_fx",), f"WITH {FRAMES} SELECT meeting_id, speaker, count(DISTINCT frame) * 100 AS ms FROM fr GROUP BY ALL")
def d12(turns):
    return diarize.speaking_time(_frames(turns), 100)


OVERLAPS = """k AS (
  SELECT meeting_id, speaker, start_ms AS ts, end_ms AS te, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, speaker) AS k FROM turns_fx
), ov AS (
  SELECT a.meeting_id, a.k, a.speaker, a.ts, a.te, coalesce(sum(greatest(0, least(a.te, b.te) - greatest(a.ts, b.ts))) FILTER (WHERE b.speaker <> a.speaker), 0)::BIGINT AS overlap_ms
  FROM k a JOIN k b ON b.meeting_id = a.meeting_id AND b.k BETWEEN a.k - 20 AND a.k + 19 GROUP BY ALL
)"""


@query("l11_turn_overlap", ("turns_fx",), f"WITH {OVERLAPS} SELECT * FROM ov")
def l11(turns):
    return speakers.turn_overlap(turns)


@query("l12_sample_candidates", ("turns_fx", "segments_fx"), f"""WITH {OVERLAPS}, fit AS (
  SELECT *, least(te - ts, 12000) AS clip FROM ov WHERE te - ts >= 2500 AND overlap_ms * 4 <= te - ts
  QUALIFY row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY te - ts DESC, k) <= 16
) SELECT meeting_id, speaker, k, greatest(0.0::DOUBLE, (ts + te - clip) / 2) AS clip_start, (ts + te + clip) / 2 AS clip_end FROM fit
WHERE NOT EXISTS (SELECT 1 FROM segments_fx s WHERE s.idx % 3 = 0 AND s.meeting_id = fit.meeting_id AND s.speaker = fit.speaker AND abs(s.start_ms - ts) < 1000)""")
def l12(turns, segments):
    return speakers.sample_candidates(l11(turns), segments.where("idx % 3 = 0"))


@query("l19_enroll_pieces", ("audio_fx",), """WITH r AS (SELECT meeting_id, count(*) AS samples FROM audio_fx GROUP BY 1), p AS (
  SELECT meeting_id, samples, unnest(range(0, greatest(1, samples - 10), 40)) AS start FROM r
) SELECT meeting_id, start, least(start + 40, samples) AS stop FROM p WHERE least(start + 40, samples) - start >= 10""")
def l19(audio):
    return speakers.enroll_pieces(audio.groupBy("meeting_id").agg(F.count("*").alias("samples")), 40, 10)


@query("p9_speaker_at", ("segments_fx", "turns_fx"), """WITH t AS (SELECT meeting_id, end_ms AS at_ms FROM turns_fx), z AS (
  SELECT meeting_id, max(end_ms) AS z FROM segments_fx GROUP BY 1
), e AS (SELECT t.meeting_id, at_ms, least(at_ms, z) AS key FROM t JOIN z USING (meeting_id))
SELECT e.meeting_id, at_ms, CASE WHEN at_ms BETWEEN start_ms - 500 AND end_ms + 500 THEN speaker END AS speaker
FROM e ASOF JOIN segments_fx s ON s.meeting_id = e.meeting_id AND e.key <= s.end_ms""")
def p9(segments, turns):
    return stats.speaker_at(segments, turns.selectExpr("meeting_id", "end_ms AS at_ms"))


@query("q11_recent_chat", ("conversations",), """SELECT conv_id AS meeting_id, turn AS id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)""")
def q11(conversations):
    return search.recent_chat(conversations.selectExpr("conv_id AS meeting_id", "turn AS id", "role"), 4)


KEY = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query("n9_clean_actions", ("actions_fx",), f"""WITH a AS (SELECT *, regexp_replace(task, '^\\s+|\\s+$', '', 'g') AS task2 FROM actions_fx)
SELECT meeting_id, idx, task2 AS task, CASE WHEN owner = 'N/A' THEN '' ELSE owner END AS owner, CASE WHEN due = 'Friday' THEN due ELSE '' END AS due,
  CASE WHEN idx * 37 <= duration_s + 5 THEN idx * 37 END AS t, false AS done FROM a WHERE task2 <> ''
QUALIFY row_number() OVER (PARTITION BY meeting_id, {KEY.format(x='task2')} ORDER BY idx) = 1""")
def n9(actions):
    return notes.clean_actions(actions)


@query("n18_action_board", ("actions_fx",), """SELECT meeting_id, count(*) FILTER (WHERE NOT done) AS open, count(*) FILTER (WHERE done) AS done,
  count(*) FILTER (WHERE NOT done AND owner = 'Speaker 1') AS visible, string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (WHERE NOT done AND owner = 'Speaker 1') AS items
FROM actions_fx GROUP BY 1 HAVING visible > 0""")
def n18(actions):
    return notes.action_board(actions, "open", "Speaker 1")


@query("s13_export_name", ("documents",), """SELECT doc_id, strftime(DATE '2024-01-01' + (doc_id % 365)::INTEGER, '%Y-%m-%d') || '_' ||
  coalesce(nullif(left(replace(trim(regexp_replace(text, '[^\\pL\\pN_\\- ]+', '', 'g')), ' ', '_'), 60), ''), 'meeting') || '.txt' AS name FROM documents""")
def s13(documents):
    rows = documents.selectExpr("doc_id", "text", "date_add(DATE '2024-01-01', cast(doc_id % 365 AS int)) AS day")
    return rows.select("doc_id", export_name("text", "day", "txt").alias("name"))


@query("s14_title_from_filename", ("pages",), """SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(
  regexp_replace(left(md5(url), 8) || '-' || replace(url, '/', '_') || '.wav', '^(.+)\\.[^.]+$', '\\1'), '^[0-9a-f]{8}-', ''), '_+', ' ', 'g')), 80), ''), 'Untitled meeting') AS title FROM pages""")
def s14(pages):
    rows = pages.selectExpr("page_id", "concat('media/', left(md5(url), 8), '-', replace(url, '/', '_'), '.wav') AS name")
    return rows.select("page_id", title_from_filename("name").alias("title"))


@query("l7_voiceprints", ("samples_fx",), """WITH s AS (
  SELECT meeting_id // 5 AS meeting_id, speaker_id AS key, id, end_ms - 800 * (speaker_id % 2) AS ms, CASE WHEN id % 11 <> 3 THEN embedding END AS embedding FROM samples_fx
), r AS (
  SELECT *, row_number() OVER (PARTITION BY meeting_id, key ORDER BY ms DESC, id) AS place, max(ms) OVER (PARTITION BY meeting_id, key) AS longest FROM s
), e AS (
  SELECT meeting_id, key, least(ms, 10000) / 1000.0 AS wt, unnest(range(1, 65)) AS dim, unnest(embedding)::DOUBLE AS x FROM r WHERE embedding IS NOT NULL AND place <= 8 AND (ms >= 1500 OR longest < 1500)
), t AS (SELECT meeting_id, key, list(x ORDER BY dim) AS v FROM (SELECT meeting_id, key, dim, sum(wt::DOUBLE * x) AS x FROM e GROUP BY ALL) GROUP BY ALL)
SELECT meeting_id, key, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM t""")
def l7(samples):
    turns = samples.selectExpr("meeting_id div 5 AS meeting_id", "speaker_id AS key", "id * 20000 AS start_ms", "id * 20000 + end_ms - 800 * (speaker_id % 2) AS end_ms", "if(id % 11 = 3, NULL, embedding) AS embedding")
    return speakers.voiceprints(turns).selectExpr("meeting_id", "key", "round(voiceprint[0], 6) AS first", "round(voiceprint[63], 6) AS last")


@query("l10_carry_decisions", ("samples_fx",), """WITH n AS (
  SELECT meeting_id, id AS key, embedding::DOUBLE[] AS v FROM samples_fx
), o AS (
  SELECT meeting_id, id + 1000000 AS old_key, CASE id % 4 WHEN 0 THEN 'named' ELSE 'confirmed' END AS status,
         list_transform(embedding, lambda x, i: x::DOUBLE + 0.02::DOUBLE * ((i - 1 + id) % 7 - 3)) AS w FROM samples_fx WHERE id % 4 < 2
), p AS (
  SELECT meeting_id, key, old_key, status, list_dot_product(v, w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(w, w)) AS likeness FROM n JOIN o USING (meeting_id)
) SELECT meeting_id, key, old_key, status, round(likeness, 6) AS likeness FROM p WHERE likeness > 0.85
QUALIFY row_number() OVER (PARTITION BY meeting_id, key ORDER BY likeness DESC, old_key) = 1""")
def l10(samples):
    status = "CASE id % 4 WHEN 0 THEN 'named' WHEN 1 THEN 'confirmed' ELSE 'auto' END AS status"
    old = samples.selectExpr("meeting_id", "id + 1000000 AS key", status, "transform(embedding, (x, i) -> cast(x AS double) + 0.02D * ((i + id) % 7 - 3)) AS embedding")
    return rounded(speakers.carry_decisions(samples.selectExpr("meeting_id", "id AS key", "embedding"), old), "likeness")


@query("l24_rename_speakers", ("speakers_fx",), """WITH c AS (SELECT id, CASE id % 3 WHEN 0 THEN 'PERSON ' || (id + 1) WHEN 1 THEN ' person ' || id ELSE 'Guest' END AS name FROM speakers_fx), t AS (
  SELECT id, trim(name) AS name, NOT EXISTS (SELECT 1 FROM speakers_fx s WHERE lower(s.name) = lower(trim(c.name)) AND s.id <> c.id) AS free FROM c
) SELECT id, name, free AND row_number() OVER (PARTITION BY lower(name), free ORDER BY id) = 1 AS accepted FROM t""")
def l24(people):
    return speakers.rename_speakers(people, people.selectExpr("id", "CASE id % 3 WHEN 0 THEN concat('PERSON ', id + 1) WHEN 1 THEN concat(' person ', id) ELSE 'Guest' END AS name"))
