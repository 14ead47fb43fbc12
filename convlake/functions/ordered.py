"""Rows of a key in order, streamed through a small generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_OUT = 10_000


def in_order(df: DataFrame, keys: list[str], order: list, step: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, rows_out: int = ROWS_OUT) -> DataFrame:
    """What `step` makes of the rows of each key, in order; keys must be the first columns of df.

    Partitions are sorted, and rows go through one at a time: a key's rows are never held together,
    so a long meeting costs time but no memory. `step` keeps what state it needs; rows_out of what it makes are held at once.
    """
    names, made = df.columns, T._parse_datatype_string(schema)
    # By a hash of the keys: a shuffle by the keys themselves is left out after a join by them, and Spark may then turn
    # that join into a broadcast one as it runs, which leaves a key's rows spread over tasks.
    rows = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    out_schema, width = to_arrow_schema(made), len(keys)

    def run(batches):
        def tuples():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in names))

        def flush(held):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out_schema)], schema=out_schema)

        held: list[tuple] = []
        for _, group in groupby(tuples(), key=lambda row: row[:width]):
            for row in step(group):
                held.append(row)
                if len(held) >= rows_out:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return rows.mapInArrow(run, made)
