"""Recordings that arrive in chunks (R, S7)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.ordered import in_order


def unfinished(chunks: DataFrame, now, silence: str = "30 SECONDS") -> DataFrame:
    """R2. Recordings (rid) silent for `silence` before now, with bytes, first and last chunk; none where now is null."""
    rows = chunks.groupBy("rid").agg(F.sum("n_bytes").alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return rows.where(F.col("last") <= F.lit(now).cast(chunks.schema["ts"].dataType) - F.expr(f"INTERVAL {silence}"))


PART_BYTES = 64_000_000


def assemble(chunks: DataFrame, least: int = 1000, part_bytes: int = PART_BYTES) -> DataFrame:
    """S7. Recordings (rid, part from 0, bytes) in order of seq, whatever the order of arrival; those under `least` bytes go. A part
    ends with the chunk that brings it to part_bytes or more, so a recording may have any size: chunks are streamed in order, and a task
    holds one part. Null chunks are empty; equal seq in order of their bytes."""
    rows = chunks.select("rid", "seq", "bytes").where("bytes IS NOT NULL")
    long = rows.groupBy("rid").agg(F.sum(F.octet_length("bytes").cast("long")).alias("size")).where(f"size >= {least}").select("rid")
    kind = chunks.schema["rid"].dataType.simpleString()

    def join(own: Iterator[tuple]) -> Iterator[tuple]:
        part, held, size = 0, [], 0
        for rid, _, piece in own:
            held.append(piece)
            size += len(piece)
            if size >= part_bytes:
                yield rid, part, b"".join(held)
                part, held, size = part + 1, [], 0
        if held:
            yield rid, part, b"".join(held)

    return in_order(rows.join(long, "rid"), ["rid"], ["seq", "bytes"], join, f"rid {kind}, part long, bytes binary", rows_out=1)
