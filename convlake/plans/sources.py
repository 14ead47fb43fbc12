"""Registered queries of sources (S1-S5, S7-S9) and of answers to parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions.written import shared_path
from convlake.operators import notes, recordings
from convlake.plans.conversations import query
from convlake.sources import tables


@query("s3_embedding_codec", ("embeddings",), "SELECT vec_id, len(embedding) * 4 AS n_bytes, round(list_sum(embedding)::DOUBLE, 4) AS total FROM embeddings")
def s3(embeddings):
    rows = embeddings.select("vec_id", tables.encode_embedding("embedding").alias("blob")).select("vec_id", "blob", tables.decode_embedding("blob").alias("v"))
    return rows.selectExpr("vec_id", "cast(octet_length(blob) AS bigint) AS n_bytes", "round(aggregate(v, 0D, (s, x) -> s + cast(x AS double)), 4) AS total")


@query("s4_parse_json", ("events",), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE (props->>'k')::BIGINT END AS k FROM events")
def s4(events):
    rows = events.selectExpr("event_id", "CASE event_id % 6 WHEN 0 THEN ' ' WHEN 3 THEN NULL ELSE props END AS props")
    return rows.select("event_id", tables.parse_json_column("props", "struct<k:bigint>", F.expr("named_struct('k', -1L)")).alias("p")).select("event_id", "p.k")


@query("s5_discover_files", ("chunks_fx",), """WITH f AS (SELECT 'in/' || CASE WHEN seq % 7 = 0 THEN '.' ELSE '' END || 'rec' || seq || CASE seq % 3 WHEN 0 THEN '.MP3' WHEN 1 THEN '.wav' ELSE '.txt' END AS path, n_bytes, floor(epoch(ts))::BIGINT AS mtime, seq FROM chunks_fx)
SELECT path, substr(path, 4) || '|' || n_bytes || '|' || mtime AS key, mtime FROM f WHERE seq % 3 <> 2 AND seq % 7 <> 0 AND seq % 5 <> 0 AND mtime <= epoch(TIMESTAMP '2024-01-15 00:00:00') - 20""")
def s5(chunks):
    path = "concat('in/', if(seq % 7 = 0, '.', ''), 'rec', seq, CASE seq % 3 WHEN 0 THEN '.MP3' WHEN 1 THEN '.wav' ELSE '.txt' END)"
    listing = chunks.selectExpr(f"{path} AS path", "n_bytes AS length", "cast(ts AS timestamp) AS modificationTime", "seq")
    seen = listing.where("seq % 5 = 0").select(F.concat_ws("|", F.substring("path", 4, 100), "length", F.unix_timestamp("modificationTime")).alias("key"))
    return tables.discover_new_files(listing, seen, F.expr("timestamp '2024-01-15 00:00:00'"))


@query("s7_assemble_recordings", ("events",), """WITH r AS (SELECT user_id AS rid, string_agg(props, '' ORDER BY event_id DESC) AS body FROM events GROUP BY 1)
SELECT rid, strlen(body) AS n_bytes, md5(body) AS digest FROM r WHERE strlen(body) >= 100""")
def s7(events):
    chunks = events.selectExpr("user_id AS rid", "-event_id AS seq", "cast(props AS binary) AS bytes")
    whole = recordings.assemble(chunks, 100, 1500).groupBy("rid").agg(F.expr("array_join(transform(array_sort(collect_list(struct(part, cast(bytes AS string) AS t))), p -> p.t), '')").alias("body"))
    return whole.selectExpr("rid", "cast(octet_length(body) AS bigint) AS n_bytes", "md5(cast(body AS binary)) AS digest")


@query("s1_read_transcripts", ("words_fx",), "SELECT meeting_id::VARCHAR AS meeting_id, idx, CASE WHEN idx % 4 = 3 THEN 0 ELSE pos END AS pos, CASE WHEN idx % 4 = 3 THEN ' whole ' || idx ELSE text END AS text, start_ms, end_ms, CASE WHEN idx % 4 = 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS prob FROM words_fx WHERE idx % 4 <> 3 OR (pos = 0 AND idx % 8 <> 7)")
def s1(words):
    """Transcripts as they are kept, a JSON file of each meeting, written and read."""
    path = shared_path(words.sparkSession, "transcripts")
    word = "array(cast(start_ms / 1000D AS string), cast(end_ms / 1000D AS string), text, '0.5')"
    segments = words.where("idx % 4 <> 3 OR pos = 0").groupBy("meeting_id", "idx").agg(
        F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.expr(f"transform(array_sort(collect_list(struct(pos, {word} AS w))), x -> x.w)").alias("w")
    )
    segment = "struct(s / 1000D AS start, e / 1000D AS end, if(idx % 8 = 7, '', if(idx % 4 = 3, concat('\t whole ', idx, ' \n'), '')) AS text, if(idx % 4 = 3, slice(w, 1, 0), w) AS words)"
    # Segments without any word keep their place as nulls.
    lists = segments.groupBy("meeting_id").agg(F.expr(f"map_from_entries(collect_list(struct(idx, {segment})))").alias("m"), F.max("idx").alias("last"))
    docs = lists.selectExpr("meeting_id", "to_json(struct(cast(meeting_id AS string) AS meeting_id, 'xx' AS language, transform(sequence(0L, last), i -> m[i]) AS segments)) AS text")
    docs.repartition("meeting_id").write.partitionBy("meeting_id").text(path)
    return tables.read_transcripts(words.sparkSession, path)


@query("s2_read_turns", ("turns_fx",), "SELECT meeting_id::VARCHAR AS meeting_id, CASE speaker WHEN 'S3' THEN 'S3' WHEN 'S1' THEN 'S2' ELSE 'S1' END AS speaker, start_ms, end_ms FROM turns_fx")
def s2(turns):
    """Turns as they are kept, a JSON file of each meeting, written and read: speaker numbers through an order of two keys."""
    path = shared_path(turns.sparkSession, "turns")
    turn = "struct(start_ms / 1000D AS start, end_ms / 1000D AS end, cast(substr(speaker, 2) AS int) - 1 AS speaker)"
    docs = turns.groupBy("meeting_id").agg(F.expr(f"collect_list({turn})").alias("turns"))
    docs = docs.selectExpr("meeting_id", "to_json(struct(cast(meeting_id AS string) AS meeting_id, array('S2', 'S1') AS `order`, turns)) AS text")
    docs.repartition("meeting_id").write.partitionBy("meeting_id").text(path)
    return tables.read_turns(turns.sparkSession, path)


@query("s9_write_by_meeting", ("segments_fx",), "SELECT meeting_id, idx, CASE WHEN meeting_id % 3 = 0 THEN 'new ' || speaker ELSE speaker END AS speaker FROM segments_fx WHERE meeting_id % 3 <> 0 OR idx % 2 = 0")
def s9(segments):
    """A table by meeting in which a third of the meetings is replaced, read back."""
    path = shared_path(segments.sparkSession, "by-meeting")
    rows = segments.select("meeting_id", "idx", "speaker")
    tables.write_by_meeting(rows, path, 16)
    tables.write_by_meeting(rows.where("meeting_id % 3 = 0 AND idx % 2 = 0").withColumn("speaker", F.concat(F.lit("new "), "speaker")), path, 16)
    return tables.read_by_meeting(segments.sparkSession, path, rows.schema).select("meeting_id", "idx", "speaker")


def _shout(prompts: list[str]) -> list[str]:
    return [f"{len(p)}:{p[:20]}" for p in prompts]


@query("n6_map_parts", ("segments_fx",), "SELECT meeting_id, idx AS part, md5(text) AS key, CASE WHEN idx % 5 <> 4 THEN length(text) || ':' || left(text, 20) END AS answer FROM segments_fx")
def n6(segments):
    return notes.map_parts(segments.selectExpr("meeting_id", "idx AS part", "md5(text) AS key", "if(idx % 5 = 4, NULL, text) AS prompt"), _shout)


@query("n7_parse_answers", ("segments_fx",), """SELECT meeting_id, idx, CASE WHEN idx % 4 = 2 THEN 'repaired' WHEN idx % 4 = 3 THEN 'bad' ELSE 'ok' END AS outcome,
  CASE WHEN idx % 4 < 3 THEN length(text) END AS n, CASE WHEN idx % 4 < 2 THEN 'a,b' WHEN idx % 4 = 2 THEN 'a' END AS points FROM segments_fx""")
def n7(segments):
    """Answers of four kinds: plain, in a fence after reasoning and with a trailing comma, cut off inside a string, and none."""
    body = "concat('{~n~: ', length(text), ', ~points~: [~a~')"
    fenced = f"concat('<think>so</think>```json ', {body}, ', ~b~,]}}```')"
    text = f"CASE idx % 4 WHEN 0 THEN concat({body}, ', ~b~]}}') WHEN 1 THEN {fenced} WHEN 2 THEN concat({body}, ', ~b') ELSE 'no answer' END"
    told = segments.select("meeting_id", "idx", F.translate(F.expr(text), "~", '"').alias("text"))
    rows = notes.parse_answers(told, "struct<n:bigint,points:array<string>>")
    return rows.selectExpr("meeting_id", "idx", "outcome", "answer.n", "array_join(answer.points, ',') AS points")
