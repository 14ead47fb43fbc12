"""What the corpus operators share: the folder all executors see, and tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints/convlake"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of its own only where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or LOCAL_SHARED).rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(made: DataFrame) -> None:
    """Remove what `materialise` wrote, once nothing will read it any more."""
    sc = made.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(made.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def doc_key() -> "F.Column":
    """doc_id as text, empty for null: what hashes of a document's id are taken of."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their group; `groups` has a row for each key, and the number of its rows in `size`.

    Groups of more than a thousandth of all rows are under a thousand: these are broadcast, so that
    their rows stay where they are. No other group is large; they meet in a shuffle.
    Both sides are read more than once and should be written tables.
    """
    least = F.lit((groups.agg(F.sum(size)).first()[0] or 0) / HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= least), key)
    return rows.join(hot, key).unionByName(cold)
