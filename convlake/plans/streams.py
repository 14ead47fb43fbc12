"""Streams run to their end over the given tables, dealt over files, with the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.written import shared_path
from convlake.plans.conversations import query
from convlake.plans.retrieval import TOKENS
from convlake.streaming import jobs

PARTS = 3


def _in_parts(rows: DataFrame, part: str, name: str) -> DataFrame:
    """rows as a stream of PARTS files, a micro-batch each, by the number that `part` gives."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    for k in range(PARTS):
        rows.where(f"{part} = {k}").sort("seq").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("r4_index_stream", ("segments_fx",), f"""WITH {TOKENS} SELECT ts[i] AS token, meeting_id, idx, any_value(len(ts)) AS len, count(*) AS tf, min(i) - 1 AS first
FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM tl) WHERE idx % 5 <> 4 GROUP BY 1, 2, 3""")
def r4(segments):
    """Every meeting comes in three parts: some segments late, some twice with another text before, every fifth taken away again."""
    spark = segments.sparkSession
    rows = segments.selectExpr("meeting_id", "idx", "1L AS version", "if(idx % 3 = 0, concat('old ', text), text) AS text", "cast(idx % 2 AS int) AS part", "idx AS seq")
    again = segments.where("idx % 3 = 0 OR idx % 5 = 4").selectExpr("meeting_id", "idx", "2L AS version", "if(idx % 5 = 4, NULL, text) AS text", "2 AS part", "idx AS seq")
    index = shared_path(spark, "word-index")
    jobs.index_stream(_in_parts(rows.unionByName(again), "part", "segments-stream"), index, shared_path(spark, "index-state")).trigger(availableNow=True).start().awaitTermination()
    kind = segments.schema["meeting_id"].dataType.simpleString()
    return jobs.read_index(spark, index, kind).selectExpr("token", "meeting_id", "idx", "len", "cast(size(places) AS bigint) AS tf", "places[0] AS first")


@query("r3_perf_ema_stream", ("perf_fx",), """WITH v AS (SELECT key, list(value::DOUBLE ORDER BY seq) AS vs FROM perf_fx GROUP BY key)
SELECT key, round(list_reduce(list_transform(range(1, len(vs) + 1), lambda i: {'x': vs[i], 'n': i}),
  lambda s, o: {'x': s.x + CASE WHEN s.n < 3 THEN 0.5 ELSE 0.3 END * (o.x - s.x), 'n': o.n}).x, 6) AS value, len(vs)::BIGINT AS samples FROM v""")
def r3(observations):
    """Observations of each key in three micro-batches; what the last update of each key says."""
    spark, out = observations.sparkSession, shared_path(observations.sparkSession, "averages")
    rows = observations.where("value IS NOT NULL").selectExpr("key", "seq", "cast(value AS double) AS value", "if(seq < 40, 0, if(seq < 200, 1, 2)) AS part")
    found = jobs.perf_ema_stream(_in_parts(rows, "part", "observations-stream")).writeStream.outputMode("update")
    found = found.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number}"))
    found.option("checkpointLocation", shared_path(spark, "average-state")).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.schema("key string, value double, samples long").option("recursiveFileLookup", True).parquet(out)
    return updates.groupBy("key").agg(F.round(F.max_by("value", "samples"), 6).alias("value"), F.max("samples").alias("samples"))
