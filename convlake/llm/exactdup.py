"""Exact deduplication: two passes over hashes with a Bloom filter, native functions only.

Texts are equal if they are once white space is taken out (by SHA-256). The first pass counts the
cells that hashes fall on; cells hit twice or more make the filter, 32,768 bits a bucket, two cells
of one bucket for each hash. The second pass asks the filter: a hash with a cell that was hit once
is nobody else's, and its row passes straight through. Only the other rows shuffle, to be grouped
by the whole digest, so a false alarm costs a little and changes nothing.

The filter has 16 bits a row, `filter_bytes` at most, and is broadcast. Above that it gets denser
and lets more rows through to the shuffle, all of them in the end; results stay the same.

Edge cases: null counts as empty; texts of white space alone are equal to the empty one; rows that
repeat, doc_id too, are told apart by a number of their own, and one of them stays; a null doc_id
comes last among equals; an empty table gives an empty result; `deduplicate` keeps other columns,
whatever their names, but for names that begin with `_dedup_`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import join_groups, materialise, table

BUCKET_BITS = 32_768  # of a bitmap of Spark's
ROWS_A_BUCKET = 2_048
FILTER_BYTES = 256_000_000
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: str) -> Column:
    """The text without white space of ASCII; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(F.col(text), F.lit("")))


def digest(text: str) -> Column:
    """SHA-256 of the normalised text, as bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def cells(key: str, buckets: int) -> list[Column]:
    """A bucket and two places in it, by hashes of a digest."""
    places = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_dedup_bucket"), places.bitwiseAND(BUCKET_BITS - 1).alias("_dedup_p"), F.shiftrightunsigned(places, 15).bitwiseAND(BUCKET_BITS - 1).alias("_dedup_q")]


def build(rows: DataFrame, key: str, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, int]:
    """First pass: (buckets with a bit for each cell that is hit twice or more, their number)."""
    buckets = max(1, min(-(-rows.count() // ROWS_A_BUCKET), 8 * filter_bytes // BUCKET_BITS))
    cell = F.explode(F.array_distinct(F.array("_dedup_p", "_dedup_q"))).alias("_dedup_place")
    hits = rows.select(*cells(key, buckets)).select("_dedup_bucket", cell).groupBy("_dedup_bucket", "_dedup_place").count()
    twice = hits.where("count > 1").groupBy("_dedup_bucket")
    return twice.agg(F.bitmap_construct_agg(F.col("_dedup_place")).alias("_dedup_bits")), buckets


def probe(rows: DataFrame, key: str, bits: DataFrame, buckets: int) -> DataFrame:
    """Second pass: rows with `_dedup_possible`, whether both cells were hit twice. No row moves: the filter is broadcast, of bounded size."""

    def on(place: str) -> Column:
        byte = F.expr(f"conv(hex(substring(_dedup_bits, cast({place} div 8 AS int) + 1, 1)), 16, 10)").cast("bigint")
        return F.getbit(byte, F.expr(f"cast({place} % 8 AS int)")) == 1

    names = rows.columns
    known = rows.select("*", *cells(key, buckets)).join(F.broadcast(bits), "_dedup_bucket", "left")
    return known.select(*names, F.coalesce(on("_dedup_p") & on("_dedup_q"), F.lit(False)).alias("_dedup_possible"))


def groups(df: DataFrame, id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """A row for each of df: id, keep_id (of the longest of its equals, then the smallest), group_size, kept, text_sha256."""
    thin = df.select(F.col(id).alias("id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("size"), digest(text).alias("key"), F.monotonically_increasing_id().alias("row"))
    thin = materialise(thin, "exactdup-digests")
    bits, buckets = build(thin, "key", filter_bytes)
    asked = materialise(probe(thin, "key", bits, buckets), "exactdup-asked")
    alone, doubtful = asked.where("NOT _dedup_possible"), asked.where("_dedup_possible").drop("_dedup_possible")
    best = F.min(F.struct(-F.col("size"), F.col("id").isNull(), F.col("id").alias("keep_id"), F.col("row").alias("keep_row")))
    found = materialise(doubtful.groupBy("key").agg(F.count("*").alias("group_size"), best.alias("best")).select("key", "group_size", "best.keep_id", "best.keep_row"), "exactdup-groups")
    judged = join_groups(doubtful, found, "key", "group_size")
    out = judged.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "key")
    out = out.unionByName(alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "key"))
    return out.select(F.col("id").alias(id), "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256"))


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """df with one whole row of each group of equal texts. Rows that the filter clears never move; of the others a task sends the best of each group."""
    bits, buckets = build(materialise(df.select(digest(text).alias("key")), "exactdup-keys"), "key", filter_bytes)
    asked = probe(df.select("*", digest(text).alias("_dedup_key")), "_dedup_key", bits, buckets)
    order = F.struct(-F.char_length(F.coalesce(F.col(text), F.lit(""))), F.col(id).isNull(), F.col(id))
    best = asked.where("_dedup_possible").groupBy("_dedup_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_dedup_row"))
    return asked.where("NOT _dedup_possible").select(*df.columns).unionByName(best.select("_dedup_row.*"))


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM texts WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
