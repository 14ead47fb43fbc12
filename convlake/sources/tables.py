"""Transcripts, turns, listings and vectors read; tables written by meeting (S)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.functions.columns import strip

TRANSCRIPT = "meeting_id string, language string, duration double, segments array<struct<start:double,end:double,text:string,words:array<array<string>>>>"
TURNS = "meeting_id string, `order` array<string>, turns array<struct<start:double,end:double,speaker:int>>"
# The endings of files with sound.
SUFFIXES = "mp3 wav m4a aac flac ogg oga opus wma aiff aif amr 3gp mp4 m4v mov mkv webm avi mpeg mpg ts".split()
SETTLE_S = 20


def _ms(column: str) -> str:
    return f"cast(bround({column} * 1000) AS bigint)"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """S1. Words (meeting_id, idx, pos, text, start_ms, end_ms, prob) of transcript documents (JSON, one or many lines a file). A
    word is an array [start, end, text, probability] of mixed types; a segment without words is one word of probability 1, a space and the
    stripped text; one without words and text is none."""
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)
    rows = docs.select("meeting_id", F.posexplode("segments").alias("idx", "s"))
    whole = f"if(s.text <> '', array(array(cast(s.start AS string), cast(s.end AS string), concat(' ', {strip('s.text')}), '1')), NULL)"
    rows = rows.select("meeting_id", F.col("idx").cast("long"), F.posexplode(F.expr(f"if(coalesce(size(s.words), 0) > 0, s.words, {whole})")).alias("pos", "w"))
    return rows.selectExpr("meeting_id", "idx", "cast(pos AS bigint) AS pos", "w[2] AS text", f"{_ms('cast(w[0] AS double)')} AS start_ms", f"{_ms('cast(w[1] AS double)')} AS end_ms", "cast(get(w, 3) AS double) AS prob")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """S2. Turns (meeting_id, speaker, start_ms, end_ms) of JSON documents; speaker numbers become keys by the document's order, or
    `S` and the number from 1 past its end."""
    rows = spark.read.schema(TURNS).option("multiLine", True).json(path).select("meeting_id", "order", F.explode("turns").alias("t"))
    return rows.selectExpr("meeting_id", "coalesce(get(`order`, t.speaker), concat('S', t.speaker + 1)) AS speaker", f"{_ms('t.start')} AS start_ms", f"{_ms('t.end')} AS end_ms")


def decode_embedding(column: str) -> Column:
    """S3. The little-endian 32-bit floats of a binary column; null for null and for broken lengths."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, dtype="<f4") if b is not None and len(b) % 4 == 0 else None)

    return decode(column)


def encode_embedding(column: str) -> Column:
    """S3. An array of floats as little-endian 32-bit floats; null for null."""

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes() if v is not None else None)

    return encode(column)


def parse_json_column(column: str, schema: str, default: Column) -> Column:
    """S4. A text column of JSON in a schema; the default where it is null, empty or broken."""
    return F.coalesce(F.from_json(F.nullif(F.trim(column), F.lit("")), schema), default)


def sound_files(listing: DataFrame) -> DataFrame:
    """Of a listing (path, length, modificationTime) the files with sound, hidden ones left out, with name, mtime and key (name, size, whole
    second of change)."""
    rows = listing.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).withColumn("mtime", F.unix_timestamp("modificationTime"))
    rows = rows.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(SUFFIXES) & ~F.col("name").startswith("."))
    return rows.withColumn("key", F.concat_ws("|", "name", "length", "mtime"))


def discover_new_files(listing: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """S5. Of a listing (path, length, modificationTime) the files with sound that lie still for 20 s and whose key is not in seen (key);
    the oldest first."""
    rows = sound_files(listing).where(F.col("mtime") <= F.unix_timestamp(now) - SETTLE_S)
    return rows.join(seen.select("key"), "key", "left_anti").select("path", "key", "mtime").orderBy("mtime", "path")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """S5. The listing of a folder; no content is read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")


BUCKET_ROWS = 1_000_000
STATES = "bucket int, version long, buckets int"


def _children(spark: SparkSession, folder: str) -> list[int]:
    """The numbered folders in a folder that a job finished writing."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path)]
    return sorted(int(f.getName()) for f in found if f.getName().isdigit() and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def _state(spark: SparkSession, path: str, version: int) -> list:
    """(bucket, version, buckets) of a state of the table: which version of each bucket holds. A row per bucket."""
    return spark.read.schema(STATES).parquet(f"{path}/states/{version}").collect()


def _folders(path: str, state: list, buckets: set[int] | None = None) -> list[str]:
    return [f"{path}/rows/{r['version']}/bucket={r['bucket']}" for r in state if r["version"] is not None and (buckets is None or r["bucket"] in buckets)]


def _bucket(buckets: int):
    return F.expr(f"cast(pmod(xxhash64(meeting_id), {buckets}) AS int)")


def write_by_meeting(rows: DataFrame, path: str, buckets: int | None = None) -> None:
    """S9. Replaces the given meetings' rows in a table kept in buckets of meeting_id and leaves all other meetings as they are.

    Buckets that change are written once, into folders of a new version; then the new state of the table, which says what version of each
    bucket holds, is written as one more folder. Readers take the last finished state, so they see all of a change or nothing, and a
    job that dies leaves the table as it was. Two writers at once: the second fails. `clear_states` removes what no reader needs.
    The first rows set the number of buckets, four for each BUCKET_ROWS of them, unless it is given. No rows change nothing."""
    spark, path = rows.sparkSession, path.rstrip("/")
    known = _children(spark, f"{path}/states")
    state = _state(spark, path, known[-1]) if known else []
    version = known[-1] + 1 if known else 0
    count = state[0]["buckets"] if state else buckets or 4 * max(1, -(-rows.count() // BUCKET_ROWS))
    new = rows.withColumn("bucket", _bucket(count))
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    if known and not touched:
        return
    old = _folders(path, state, touched)
    whole = new
    if old:
        kept = spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(*old).join(rows.select("meeting_id").distinct(), "meeting_id", "left_anti")
        whole = kept.select(*rows.columns).withColumn("bucket", _bucket(count)).unionByName(new)
    whole.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/rows/{version}")
    held = {b: None for b in range(count)} | {r["bucket"]: r["version"] for r in state} | {b: version for b in touched}
    spark.createDataFrame([(b, v, count) for b, v in held.items()], STATES).coalesce(1).write.parquet(f"{path}/states/{version}")


def read_by_meeting(spark: SparkSession, path: str, schema: T.StructType, meetings: list | None = None) -> DataFrame:
    """S8. A table of windows, vectors or segments as write_by_meeting keeps it; of `meetings` alone, only their buckets are read."""
    path = path.rstrip("/")
    known = _children(spark, f"{path}/states")
    state = _state(spark, path, known[-1]) if known else []
    only = None
    if meetings is not None and state:
        asked = spark.createDataFrame([(m,) for m in meetings], T.StructType([schema["meeting_id"]]))
        only = {r["b"] for r in asked.select(_bucket(state[0]["buckets"]).alias("b")).distinct().collect()}
    folders = _folders(path, state, only)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows if meetings is None else rows.where(F.col("meeting_id").isin(meetings))


def clear_states(spark: SparkSession, path: str, keep: int = 2) -> None:
    """S9. Removes all states but the last `keep`, and the rows that only those removed had: readers of older states must be done."""
    path, sc = path.rstrip("/"), spark.sparkContext
    known = _children(spark, f"{path}/states")
    needed = {folder for v in known[-keep:] for folder in _folders(path, _state(spark, path, v))}
    gone = {folder for v in known[:-keep] for folder in _folders(path, _state(spark, path, v))} - needed
    for folder in [*(f"{path}/states/{v}" for v in known[:-keep]), *sorted(gone)]:
        at = sc._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
