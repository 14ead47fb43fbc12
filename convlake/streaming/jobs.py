"""Streaming forms of batch operators (R). States are kept by key in RocksDB and outlive a lost executor with the checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from convlake.operators.search import build_index
from convlake.sources.tables import SETTLE_S, sound_files

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LISTING = "path string, modificationTime timestamp, length long, content binary"


def _keyed_states(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def finished_recordings(chunks: DataFrame, silence: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """R2. Recordings (rid) once they have been silent for `silence`, with bytes, first and last chunk; a session that goes
    on after a silence is a row of its own. Chunks later than `late` behind the newest are dropped by the watermark."""
    rows = chunks.withWatermark("ts", late).groupBy("rid", F.session_window("ts", silence).alias("w"))
    return rows.agg(F.sum("n_bytes").alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


class _Average(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("average", "value double, samples long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mean, n = self.state.get() if self.state.exists() else (0.0, 0)
        for part in rows:
            for value in part.sort_values("seq", kind="stable")["value"]:
                mean = value if n == 0 else mean + (0.5 if n < 3 else 0.3) * (value - mean)
                n += 1
        self.state.update((float(mean), int(n)))
        yield pd.DataFrame({"key": [key[0]], "value": [float(mean)], "samples": [n]})

    def close(self) -> None:
        pass


def perf_ema_stream(observations: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """R3. M5 as keyed state (value, samples): after each micro-batch the average of every key in it. Rows come in Arrow batches, one at
    a time; within one they count in order of seq, batches as they arrive. Nulls are left out. A key that is quiet for ttl_ms begins anew."""
    _keyed_states(observations.sparkSession)
    rows = observations.where("value IS NOT NULL").selectExpr("key", "seq", "cast(value AS double) AS value")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(_Average(ttl_ms), "key string, value double, samples long", "Update", mode)


class _Settle(StatefulProcessor):
    """State: the files that are too young; a timer hands each over when it is old enough."""

    def __init__(self, settle_ms: int, deliver: bool):
        self.settle_ms, self.deliver = settle_ms, deliver

    def init(self, handle) -> None:
        self.handle = handle
        self.young = handle.getValueState("young", "key string, mtime_ms long")

    def _hand_over(self, path: str, file_key: str, mtime_ms: int) -> pd.DataFrame:
        return pd.DataFrame({"path": [path], "key": [file_key], "mtime": [mtime_ms // 1000]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if not self.deliver:
                continue
            for file_key, mtime_ms in zip(part["key"], part["mtime_ms"]):
                due = int(mtime_ms) + self.settle_ms
                if due <= timerValues.getCurrentProcessingTimeInMs():
                    yield self._hand_over(key[0], file_key, int(mtime_ms))
                else:
                    self.young.update((file_key, int(mtime_ms)))
                    self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.young.exists():
            file_key, mtime_ms = self.young.get()
            self.young.clear()
            if self.deliver:
                yield self._hand_over(key[0], file_key, mtime_ms)

    def close(self) -> None:
        pass


def new_files(spark: SparkSession, folder: str, settle_s: float = SETTLE_S, deliver: bool = True) -> DataFrame:
    """R1. A stream of the files with sound in a folder (path, key, mtime) once they have lain still for settle_s. Spark's file source
    remembers which it has met, however old their time stamps; only files that are still too young are held in a state."""
    _keyed_states(spark)
    source = spark.readStream.format("binaryFile").schema(LISTING).option("maxFileAge", "36500d").load(folder)
    rows = sound_files(source.select("path", "length", "modificationTime")).selectExpr("path", "key", "unix_millis(modificationTime) AS mtime_ms")
    return rows.groupBy("path").transformWithStateInPandas(_Settle(int(settle_s * 1000), deliver), "path string, key string, mtime long", "Append", "ProcessingTime")


def watch_stream(spark: SparkSession, folder: str, arrived: Callable[[DataFrame], None], checkpoint: str, settle_s: float = SETTLE_S):
    """R1. A query that follows a folder and hands new files over, as one DataFrame (path, key, mtime) per micro-batch. A batch that fails
    half-way is repeated: files are handed over once or more, never lost. What a batch costs doesn't grow with the files met before.

    A file is met under its path once: what goes on writing to a file for longer than settle_s should write elsewhere and move it here."""
    files = new_files(spark, folder, settle_s).writeStream.outputMode("append")
    return files.foreachBatch(lambda batch, _: arrived(batch)).option("checkpointLocation", checkpoint)


def baseline(spark: SparkSession, folder: str, checkpoint: str) -> None:
    """R1. Counts the files that are in the folder now as met, so that a watch with this checkpoint hands over only new ones."""
    met = new_files(spark, folder, deliver=False).writeStream.outputMode("append").foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save())
    met.option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()


def import_existing(spark: SparkSession, checkpoint: str) -> None:
    """R1. Forgets what was met: a watch with this checkpoint hands over the files that are in the folder too."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class _Versions(StatefulProcessor):
    """State: the version of each segment of a meeting. Passes on what is newer, with the version that it replaces."""

    def __init__(self, meeting: str):
        self.meeting = meeting

    def init(self, handle) -> None:
        self.known = handle.getMapState("versions", "idx long", "version long, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.sort_values(["idx", "version"], kind="stable").drop_duplicates("idx", keep="last")
            for idx, version, text in zip(part["idx"], part["version"], part["text"]):
                idx, version = int(idx), int(version)
                old = self.known.getValue((idx,)) if self.known.containsKey((idx,)) else None
                if old is None or version > old[0]:
                    self.known.updateValue((idx,), (version, text is None))
                    yield pd.DataFrame({"meeting_id": [key[0]], "idx": [idx], "version": [version], "text": [text], "replaced": pd.array([None if old is None or old[1] else old[0]], dtype="Int64")})

    def close(self) -> None:
        pass


def segment_changes(segments: DataFrame) -> DataFrame:
    """R4. Of a stream of segments (meeting_id, idx, version, text) those that are newer than what was known of them, with the version that
    they replace; a null text takes a segment away. A repeated or late version changes nothing."""
    _keyed_states(segments.sparkSession)
    kind = segments.schema["meeting_id"].dataType.simpleString()
    schema = f"meeting_id {kind}, idx long, version long, text string, replaced long"
    rows = segments.where("meeting_id IS NOT NULL AND idx IS NOT NULL").selectExpr("meeting_id", "cast(idx AS bigint) AS idx", "cast(coalesce(version, 0) AS bigint) AS version", "text")
    return rows.groupBy("meeting_id").transformWithStateInPandas(_Versions(kind), schema, "Update", "None")


def index_stream(segments: DataFrame, index: str, checkpoint: str):
    """R4. A query that keeps a word index of segments (meeting_id, idx, version, text) up to date: a meeting may come in any number of
    micro-batches, and what a batch writes are the postings of the segments that it changes, and which older ones they replace.
    A repeated batch writes the same folder again. `read_index` gives what holds."""

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        postings = build_index(batch.where("text IS NOT NULL").select("meeting_id", "idx", "text"))
        postings = postings.join(batch.select("meeting_id", "idx", "version"), ["meeting_id", "idx"]).sortWithinPartitions("token")
        postings.write.mode("overwrite").parquet(f"{index}/postings/batch={number}")
        batch.where("replaced IS NOT NULL").selectExpr("meeting_id", "idx", "replaced AS version").write.mode("overwrite").parquet(f"{index}/replaced/batch={number}")
        batch.unpersist()

    return segment_changes(segments).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of batches; empty where none was written."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return spark.createDataFrame([], schema)


def read_index(spark: SparkSession, index: str, meeting: str = "string") -> DataFrame:
    """R4. The postings (token, meeting_id, idx, len, places) that no later version replaces. A filter on token reaches the scan."""
    whole = T._parse_datatype_string(f"meeting_id {meeting}, idx long, token string, len long, places array<bigint>, version long")
    gone = _table(spark, f"{index}/replaced", T._parse_datatype_string(f"meeting_id {meeting}, idx long, version long"))
    rows = _table(spark, f"{index}/postings", whole).join(gone, ["meeting_id", "idx", "version"], "left_anti")
    return rows.select("token", "meeting_id", "idx", "len", "places")
