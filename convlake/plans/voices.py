"""Registered queries from windows and vectors to speakers, and from voices to people."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import diarize, speakers
from convlake.plans.conversations import SUMS, query, rounded

STEP = 4
COUNTS = f"""wf AS (SELECT meeting_id, chunk, local, chunk * {STEP} + f AS frame, frames[f + 1] AS "on" FROM (SELECT *, unnest(range(0, 20)) AS f FROM windows_fx)), fc AS (
  SELECT meeting_id, frame, round_even(sum("on") / count(DISTINCT chunk), 0)::BIGINT AS speakers FROM wf GROUP BY 1, 2
)"""


@query("d2_frame_counts", ("windows_fx",), f"WITH {COUNTS} SELECT * FROM fc")
def d2(windows):
    return diarize.frame_counts(windows, STEP)


TRAIN = """tv AS (
  SELECT meeting_id, chunk, local, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v, row_number() OVER (PARTITION BY meeting_id ORDER BY chunk, local) - 1 AS p, count(*) OVER (PARTITION BY meeting_id) AS n
  FROM windows_fx WHERE embedding IS NOT NULL AND list_sum(frames) > 0
)"""


@query("d3_trainable_vectors", ("windows_fx",), f"WITH {TRAIN} SELECT meeting_id, chunk, local, round(v[1], 6) AS first FROM tv WHERE n <= 30 OR p IN (SELECT round_even(i * (n - 1) / 29.0::DOUBLE, 0) FROM range(0, 30) r(i))")
def d3(windows):
    return diarize.trainable_vectors(windows, 30).selectExpr("meeting_id", "chunk", "local", "round(vector[0], 6) AS first")


def _labels(windows):
    vectors = diarize.trainable_vectors(windows)
    return vectors, diarize.cluster_vectors(vectors, 1.1, 2, 2, 6)


@query("d4_cluster_vectors", ("windows_fx",), None)
def d4(windows):
    return _labels(windows)[1]


@query("d6_merge_by_anchors", ("windows_fx", "samples_fx"), f"""WITH {TRAIN}, {SUMS}, ce AS (
  SELECT meeting_id, chunk % 4 AS cluster, list(x ORDER BY dim) AS t FROM (SELECT meeting_id, chunk, dim, sum(x) AS x FROM (SELECT meeting_id, chunk % 4 AS chunk, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM tv) GROUP BY 1, 2, 3) GROUP BY 1, 2
), sc AS (SELECT meeting_id, cluster, speaker_id, list_dot_product(t, total) / sqrt(list_dot_product(t, t) * list_dot_product(total, total)) AS score FROM ce, s
), be AS (SELECT meeting_id, cluster, arg_max(speaker_id, score) AS who, max(score) AS score FROM sc GROUP BY 1, 2
), tg AS (SELECT ce.*, CASE WHEN score >= 0.1 THEN who ELSE -1 - ce.cluster END AS g FROM ce JOIN be USING (meeting_id, cluster)
), lf AS (SELECT meeting_id, CASE WHEN count(*) OVER (PARTITION BY meeting_id) - count(*) OVER (PARTITION BY meeting_id, g) + 1 < 2 THEN cluster ELSE min(cluster) OVER (PARTITION BY meeting_id, g) END AS cluster, t FROM tg
), mg AS (SELECT meeting_id, cluster, list(x ORDER BY dim) AS t FROM (SELECT meeting_id, cluster, dim, sum(x) AS x FROM (
  SELECT meeting_id, cluster, unnest(range(1, 65)) AS dim, unnest(list_transform(t, lambda x: x / sqrt(list_dot_product(t, t)))) AS x FROM lf) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT meeting_id, cluster, round(t[1] / sqrt(list_dot_product(t, t)), 6) AS first FROM mg""")
def d6(windows, samples):
    vectors = diarize.active_vectors(windows)  # sums of all of them: only clustering (D4) needs a limit
    cents = diarize.centroids(vectors, vectors.selectExpr("meeting_id", "chunk", "local", "chunk % 4 AS cluster"))
    anchors = speakers.profiles(samples).selectExpr("speaker_id", "'cur' AS model", "centroid AS embedding")
    best = speakers.match_scores(cents.selectExpr("meeting_id", "cluster AS key", "centroid AS embedding"), anchors, keep=1).withColumnRenamed("key", "cluster")
    return diarize.merge_by_anchors(cents, best, 0.1, 2).selectExpr("meeting_id", "cluster", "round(centroid[0], 6) AS first")


@query("d7_assign_windows", ("windows_fx",), None)
def d7(windows):
    return diarize.assign_windows(windows, diarize.centroids(*_labels(windows)))


@query("d8_reconstruct", ("windows_fx",), f"""WITH {COUNTS}, vo AS (
  SELECT meeting_id, frame, speaker, count(*) AS votes FROM (SELECT DISTINCT meeting_id, chunk, frame, (chunk * 5 + local) % 4 // 2 + local // 2 AS speaker FROM wf WHERE "on" > 0) GROUP BY 1, 2, 3
), pl AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, frame ORDER BY votes DESC, speaker) AS place FROM vo)
SELECT meeting_id, frame, speaker FROM pl JOIN fc USING (meeting_id, frame) WHERE place <= speakers AND frame < 50 + meeting_id""")
def d8(windows):
    dealt = windows.selectExpr("meeting_id", "chunk", "local", "(chunk * 5 + local) % 4 div 2 + local div 2 AS speaker")
    ends = windows.selectExpr("meeting_id", "50 + meeting_id AS frames").distinct()
    return diarize.reconstruct(windows, dealt, STEP, ends)


@query("d10_fold_minor_speakers", ("windows_fx",), None)
def d10(windows):
    kept = diarize.fold_minor_speakers(windows, diarize.centroids(*_labels(windows)), STEP, 16.875)
    return kept.selectExpr("meeting_id", "cluster", "round(centroid[0], 6) AS first")


@query("l6_prune_samples", ("samples_fx",), """WITH RECURSIVE v AS (SELECT id, speaker_id, embedding::DOUBLE[] AS e FROM samples_fx WHERE model = 'cur'), pr AS MATERIALIZED (
  SELECT a.speaker_id, a.id AS i, b.id AS j, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS sim FROM v a JOIN v b ON a.speaker_id = b.speaker_id AND a.id <> b.id
), st AS (
  SELECT speaker_id, list(id) AS alive FROM v GROUP BY 1
  UNION ALL
  SELECT speaker_id, list_filter(a, lambda x: x <> g) FROM (SELECT st.speaker_id, any_value(alive) AS a, arg_min(i, {'s': -round(sim, 12), 'i': i}) AS g FROM st JOIN pr ON pr.speaker_id = st.speaker_id AND list_contains(alive, i) AND list_contains(alive, j) WHERE len(alive) > 8 GROUP BY st.speaker_id, len(alive))
), en AS (SELECT speaker_id, arg_min(alive, len(alive)) AS alive FROM st GROUP BY 1)
SELECT speaker_id, unnest(alive) AS id FROM en UNION ALL SELECT speaker_id, id FROM samples_fx WHERE model <> 'cur'""")
def l6(samples):
    return speakers.prune(samples, 8)


PROBES = f"""{SUMS}, pe AS (SELECT speaker_id, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM v WHERE id % 2 = 0), pr AS (
  SELECT speaker_id % 3 AS meeting_id, 'S' || (speaker_id + 1) AS key, list(x ORDER BY dim) AS t FROM (SELECT speaker_id, dim, sum(x) AS x FROM pe GROUP BY 1, 2) GROUP BY speaker_id
), si AS (
  SELECT meeting_id, key, v.speaker_id, list_dot_product(t, v) / sqrt(list_dot_product(t, t)) AS sim, list_dot_product(t, total) / sqrt(list_dot_product(t, t) * list_dot_product(total, total)) AS cent FROM pr, v JOIN s USING (speaker_id)
), sc AS (
  SELECT meeting_id, key, speaker_id, 0.6::DOUBLE * any_value(cent) + 0.4::DOUBLE * avg(sim) FILTER (WHERE place <= 3) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, key, speaker_id ORDER BY sim DESC) AS place FROM si) GROUP BY 1, 2, 3
)"""


def _probes(samples):
    half = speakers.profiles(samples.where("id % 2 = 0"))
    return half.selectExpr("speaker_id % 3 AS meeting_id", "concat('S', speaker_id + 1) AS key", "centroid AS embedding")


@query("l8_match_scores", ("samples_fx",), f"WITH {PROBES} SELECT meeting_id, key, speaker_id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY meeting_id, key ORDER BY score DESC, speaker_id) <= 8")
def l8(samples):
    return rounded(speakers.match_scores(_probes(samples), samples, keep=8), "score")


# Every way to deal people to the voices of a meeting; the one with the greatest total counts.
@query("l9_recognise", ("samples_fx",), f"""WITH RECURSIVE {PROBES}, vo AS (
  SELECT meeting_id, key, row_number() OVER (PARTITION BY meeting_id ORDER BY key) AS i, count(*) OVER (PARTITION BY meeting_id) AS m FROM (SELECT DISTINCT meeting_id, key FROM sc)
), p AS MATERIALIZED (SELECT meeting_id, key, i, m, speaker_id, score FROM vo JOIN sc USING (meeting_id, key)), cb AS (
  SELECT meeting_id, i, m, [speaker_id] AS who, score AS total FROM p WHERE i = 1
  UNION ALL
  SELECT cb.meeting_id, p.i, cb.m, list_append(who, p.speaker_id), total + p.score FROM cb JOIN p ON p.meeting_id = cb.meeting_id AND p.i = cb.i + 1 AND NOT list_contains(who, p.speaker_id)
), be AS (SELECT meeting_id, arg_max(who, total) AS who FROM cb WHERE i = m GROUP BY 1), r AS (
  SELECT p.meeting_id, p.key, p.speaker_id AS person, p.score, (SELECT max(q.score) FROM p q WHERE q.meeting_id = p.meeting_id AND q.i = p.i AND q.speaker_id <> p.speaker_id) AS next
  FROM p JOIN be ON be.meeting_id = p.meeting_id AND be.who[p.i] = p.speaker_id
), s2 AS (SELECT *, CASE WHEN score >= 0.62 AND score - next >= 0.05 THEN 'auto' WHEN score >= 0.48 THEN 'suggested' ELSE 'unknown' END AS status FROM r)
SELECT meeting_id, key, status, round(score, 3) AS confidence, CASE WHEN status = 'auto' THEN person END AS speaker_id, CASE WHEN status = 'suggested' THEN person END AS suggested_id FROM s2""")
def l9(samples):
    return speakers.recognise(speakers.match_scores(_probes(samples), samples)).withColumn("confidence", F.round("confidence", 3))
