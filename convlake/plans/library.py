"""Registered queries of meetings, edits and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import meetings as ops
from convlake.operators import notes, speakers
from convlake.plans.conversations import query

DATED = "coalesce(recorded_s, created_s) AS date_s"


@query("p2_list_meetings", ("meetings_fx", "meeting_speakers_fx"), f"""WITH c AS (SELECT meeting_id AS id, string_agg(key, ',' ORDER BY talk_ms DESC, key) AS speakers FROM meeting_speakers_fx GROUP BY 1)
SELECT id, title, {DATED}, coalesce(speakers, '') AS speakers FROM meetings_fx LEFT JOIN c USING (id)
WHERE (contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'la') OR contains(translate(summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'la')) AND favorite""")
def p2(meetings, meeting_speakers):
    return ops.list_meetings(meetings, meeting_speakers, " LA", True)


@query("p3_speaker_meetings", ("meetings_fx", "meeting_speakers_fx"), f"SELECT id, title, {DATED}, t.talk_ms FROM meetings_fx JOIN (SELECT meeting_id, sum(talk_ms)::BIGINT AS talk_ms FROM meeting_speakers_fx WHERE speaker_id = 3 GROUP BY 1) t ON t.meeting_id = id")
def p3(meetings, meeting_speakers):
    return ops.speaker_meetings(meetings, meeting_speakers, 3)


@query("p4_find_by_name", ("speakers_fx", "segments_fx"), "SELECT DISTINCT ' PERSON ' || idx AS name, id FROM segments_fx JOIN speakers_fx ON lower(name) = 'person ' || idx")
def p4(people, segments):
    return ops.find_by_name(people, segments.selectExpr("concat(' PERSON ', idx) AS name"))


@query("p6_vocabulary", ("meetings_fx", "speakers_fx"), """WITH n AS (SELECT id, name FROM speakers_fx ORDER BY id % 4 DESC, id LIMIT 30), w AS (
  SELECT id AS meeting_id, regexp_replace(string_split_regex(v, '[,\\n;]+')[p], '^\\s+|\\s+$', '', 'g') AS word, p FROM (SELECT *, unnest(range(1, len(string_split_regex(v, '[,\\n;]+')) + 1)) AS p FROM (SELECT id, summary || ';person 3' || chr(9) AS v FROM meetings_fx))
  UNION ALL SELECT m.id, n.name, 1000 + row_number() OVER (PARTITION BY m.id ORDER BY n.id % 4 DESC, n.id) FROM meetings_fx m, n
), f AS (SELECT meeting_id, arg_min(word, p) AS word, min(p) AS p FROM w WHERE word <> '' GROUP BY meeting_id, lower(word))
SELECT meeting_id, left(string_agg(word, ', ' ORDER BY p), 600) AS words FROM f GROUP BY 1""")
def p6(meetings, people):
    return ops.vocabulary(meetings.selectExpr("id AS meeting_id", "concat(summary, ';person 3\t') AS vocabulary"), people.selectExpr("id", "name", "id % 4 AS updated"))


@query("p10_meeting_edits", ("meetings_fx", "segments_fx"), """WITH e AS (
  SELECT meeting_id AS id, arg_max(left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 200), idx) FILTER (WHERE idx % 2 = 1 AND regexp_matches(text, '\\S')) AS t,
    arg_max(speaker = 'S1', idx) FILTER (WHERE idx % 3 = 0) AS f, max(idx) AS x FROM segments_fx WHERE meeting_id % 2 = 0 GROUP BY 1)
SELECT id, coalesce(t, title) AS title, coalesce(f, favorite) AS favorite,
  CASE WHEN x IS NULL THEN 'old' ELSE array_to_string(list_concat([left('tag ' || x || ' with a long name of more than forty', 40), ' '], list_transform(range(3, 21), lambda i: ' ' || i)), ',') END AS tags, t IS NOT NULL AS locked
FROM meetings_fx LEFT JOIN e USING (id)""")
def p10(meetings, segments):
    edits = segments.where("meeting_id % 2 = 0").selectExpr("meeting_id AS id", "idx AS seq", "if(idx % 2 = 0, ' ', concat('\t', text)) AS title", "if(idx % 3 = 0, speaker = 'S1', NULL) AS favorite", "concat(array(concat('tag ', idx, ' with a long name of more than forty'), ' '), transform(sequence(3, 30), i -> concat(' ', i))) AS tags")
    return ops.apply_meeting_edits(meetings.selectExpr("id", "title", "favorite", "array('old') AS tags", "false AS locked"), edits).withColumn("tags", F.array_join("tags", ","))


@query("m6_expected_time", ("perf_fx",), """WITH m AS (SELECT DISTINCT key, length(key) / 10.0::DOUBLE AS cpu FROM perf_fx), v AS (SELECT key, avg(value) AS value FROM perf_fx WHERE length(key) > 4 GROUP BY 1)
SELECT key, value IS NOT NULL AS measured, round(60 * coalesce(value, cpu * 0.5), 6) AS minutes FROM m LEFT JOIN v USING (key)""")
def m6(observations):
    models = observations.selectExpr("key", "length(key) / 10D AS cpu", "length(key) / 100D AS gpu").distinct()
    return ops.expected_time(models, observations.where("length(key) > 4").groupBy("key").agg(F.avg("value").alias("value")), 16).withColumn("minutes", F.round("minutes", 6))


@query("l13_typical_samples", ("samples_fx",), """WITH v AS (
  SELECT meeting_id // 5 AS meeting_id, speaker_id AS key, id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM samples_fx
), e AS (SELECT meeting_id, key, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM v), s AS (
  SELECT meeting_id, key, list(x ORDER BY dim) AS total FROM (SELECT meeting_id, key, dim, sum(x) AS x FROM e GROUP BY ALL) GROUP BY 1, 2
), c AS (SELECT meeting_id, key, id, round(list_dot_product(v, total) / sqrt(list_dot_product(total, total)), 6) AS likeness FROM v JOIN s USING (meeting_id, key))
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY meeting_id, key ORDER BY likeness DESC, id) <= 2""")
def l13(samples):
    return speakers.typical_samples(samples.selectExpr("meeting_id div 5 AS meeting_id", "speaker_id AS key", "id", "embedding"), 2)


@query("l14_auto_learn", ("meeting_speakers_fx",), "SELECT meeting_id, key FROM meeting_speakers_fx WHERE status = 'auto' AND talk_ms % 100 >= 70")
def l14(meeting_speakers):
    return speakers.auto_learn(meeting_speakers.withColumn("confidence", F.expr("(talk_ms % 100) / 100D")), 0.62).select("meeting_id", "key")


@query("l16_forget_meeting", ("samples_fx",), """WITH s AS (SELECT id, meeting_id, 'clip' || (id // 3) AS clip FROM samples_fx)
SELECT 'sample' AS kind, id::VARCHAR AS name FROM s WHERE meeting_id <> 3 UNION ALL
SELECT DISTINCT 'orphan', clip FROM s WHERE meeting_id = 3 AND clip NOT IN (SELECT clip FROM s WHERE meeting_id <> 3)""")
def l16(samples):
    own = samples.selectExpr("id", "meeting_id", "concat('clip', id div 3) AS clip")
    left, orphans = ops.drop_samples(own, own.where("meeting_id = 3"))
    return left.selectExpr("'sample' AS kind", "cast(id AS string) AS name").unionByName(orphans.selectExpr("'orphan' AS kind", "clip AS name"))


@query("l17_delete_speakers", ("meeting_speakers_fx", "speakers_fx"), """SELECT meeting_id, key, CASE WHEN speaker_id IN (2, 5) THEN 'Person ' || speaker_id ELSE label END AS label, CASE WHEN speaker_id IN (2, 5) THEN 'unknown' ELSE status END AS status,
  CASE WHEN speaker_id NOT IN (2, 5) THEN speaker_id END AS speaker_id, CASE WHEN talk_ms % 10 NOT IN (2, 5) THEN talk_ms % 10 END AS suggested_id FROM meeting_speakers_fx""")
def l17(meeting_speakers, people):
    return ops.delete_speakers(meeting_speakers.withColumn("suggested_id", F.expr("talk_ms % 10")), people, people.where("id IN (2, 5)"))


WHOLE = "'(^|[^\\pL\\pN_])la($|[^\\pL\\pN_])', '\\1[L$1.]\\2', 'g')"


@query("l23_rename_in_notes", ("documents",), f"SELECT doc_id AS meeting_id, regexp_replace(regexp_replace(text, {WHOLE}, {WHOLE} AS text FROM documents")
def l23(documents):
    renames = documents.selectExpr("doc_id AS meeting_id", "'la' AS old", "'[L$1.]' AS new")
    return notes.rename_in_notes(documents.selectExpr("doc_id AS meeting_id", "text"), renames, ["text"])


ITEMS = "it AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) - 1 AS number, task, owner, due, done FROM actions_fx)"


def _items(actions):
    return actions.selectExpr("meeting_id", "cast(row_number() OVER (PARTITION BY meeting_id ORDER BY idx) - 1 AS bigint) AS number", "task", "owner", "due", "done")


@query("n17_action_items", ("actions_fx",), f"WITH {ITEMS} SELECT meeting_id, 'Talk ' || meeting_id AS title, meeting_id % 7 AS date_s, number, task, owner FROM it")
def n17(actions):
    lists = _items(actions).groupBy("meeting_id").agg(F.expr("transform(array_sort(collect_list(struct(number, task, owner))), a -> struct(a.task, a.owner))").alias("action_items"))
    return ops.action_items(lists.selectExpr("meeting_id AS id", "concat('Talk ', meeting_id) AS title", "meeting_id % 7 AS date_s", "action_items"))


@query("n19_update_actions", ("actions_fx",), f"""WITH {ITEMS} SELECT meeting_id, number, CASE WHEN number % 2 = 1 THEN 'Changed' ELSE task END AS task, owner, CASE WHEN number % 2 = 1 THEN 'Monday' ELSE due END AS due, number % 2 = 1 OR done AS done, false AS rejected FROM it
UNION ALL SELECT meeting_id, number + 1000, 'Changed', NULL, 'Monday', true, true FROM it WHERE number % 2 = 0""")
def n19(actions):
    items = _items(actions)
    changes = items.selectExpr("meeting_id", "if(number % 2 = 1, number, number + 1000) AS number", "1 AS seq", "'Changed' AS task", "cast(NULL AS string) AS owner", "'Monday' AS due", "true AS done")
    done, rejected = ops.update_actions(items, changes)
    return done.withColumn("rejected", F.lit(False)).unionByName(rejected.drop("seq").withColumn("rejected", F.lit(True)))
