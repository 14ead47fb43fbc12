"""Product codes of vectors, with distances read from dictionaries of values.

A component becomes the integer floor(1024 x). Vectors are packed once into chunks; a chunk has for
each dimension the dictionary of the distinct integers in it, and vectors as codes into it. To
compare with a codebook, a chunk tabulates for each dimension the squared differences of every
distinct integer to all entries; the distances of all its parts are then rows gathered from these
tables by code, and added. Chunks are read again in each round, from the shared folder.

Codebooks are bounded (entries times dimensions) and live on the driver between rounds; of the
vectors only sums per entry get there, added up on the executors.

Edge cases: a vector that is null or holds a null or non-finite component goes, and so does one
whose length is not that of the vector with the smallest id; of equal ids the smaller vector comes
first, null ids last; fewer vectors than entries make a smaller codebook; lengths that the parts do
not divide are filled up with zeros; a component so large that a squared distance could exceed 64 bits
counts as the largest that cannot; repeated rows are coded one by one; labels may be null; sums over 64 bits
are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from convlake.llm.common import join_groups, materialise, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
CHUNK = 4096  # vectors, so that codes of a chunk's dictionaries take 16 bits
CHUNK_BYTES = 16_000_000
BLOCK = 512  # vectors whose distances are held at once


def finite(vector: str) -> str:
    """SQL: the vector is whole."""
    return f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def integers(rows: np.ndarray, width: int) -> np.ndarray:
    """floor(1024 x), held within what squared distances of so many dimensions allow, filled up to `width` columns."""
    most = math.isqrt((2**63 - 1) // max(1, width)) // 2
    whole = np.floor(np.clip(rows.astype(np.float64) * 1024.0, -most, most)).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, width - whole.shape[1])))


class Chunk:
    """Vectors as codes into a dictionary of each dimension."""

    def __init__(self, dictionary: list[np.ndarray], codes: np.ndarray):
        self.dictionary, self.codes = dictionary, codes  # codes: dimensions x vectors

    @staticmethod
    def of(values: np.ndarray) -> "Chunk":
        found = [np.unique(column, return_inverse=True) for column in values.T]
        return Chunk([d for d, _ in found], np.array([c for _, c in found], dtype=np.uint16).reshape(values.shape[1], len(values)))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return np.concatenate([np.empty(0, np.int64), *self.dictionary]).astype("<i8").tobytes(), np.array([len(d) for d in self.dictionary], "<i4").tobytes(), self.codes.astype("<u2").tobytes()

    @staticmethod
    def read(values: bytes, sizes: bytes, codes: bytes) -> "Chunk":
        ends = np.cumsum(np.frombuffer(sizes, "<i4"))
        dims = len(ends)
        return Chunk(np.split(np.frombuffer(values, "<i8"), ends[:-1]) if dims else [], np.frombuffer(codes, "<u2").reshape(dims, -1) if dims else np.empty((0, 0), np.uint16))

    def nearest(self, book: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the part that begins at dimension `first` for each of n vectors; ties to the lower entry."""
        entries, width = book.shape
        dims = range(first, first + width)
        reach = sum(max(int(abs(self.dictionary[d] - c).max()) for c in (book[:, d - first].min(), book[:, d - first].max())) ** 2 for d in dims)
        kind = np.int32 if reach < 2**31 else np.int64
        tables = [((self.dictionary[d][:, None] - book[:, d - first][None, :]) ** 2).astype(kind) for d in dims]
        entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        held, more = np.empty((BLOCK, entries), kind), np.empty((BLOCK, entries), kind)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            total, add = held[: b - a], more[: b - a]
            total[:] = 0
            for t, d in zip(tables, dims):
                np.take(t, self.codes[d, a:b], axis=0, out=add, mode="clip")
                total += add
            entry[a:b] = total.argmin(axis=1)
            distance[a:b] = total[np.arange(b - a), entry[a:b]]
        return entry, distance

    def values(self, first: int, width: int) -> np.ndarray:
        return np.array([self.dictionary[d][self.codes[d]] for d in range(first, first + width)], np.int64).reshape(width, -1).T


def _kept(df: DataFrame, id: str, vector: str, keep: list[str]) -> DataFrame:
    return df.select(F.col(id).alias("id"), F.col(vector).alias("vector"), *[F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)]).where(finite("vector"))


def _chunks(rows: DataFrame, length: int, width: int, keep: int) -> DataFrame:
    """Rows of up to CHUNK vectors as dictionaries and codes, with the lists of their ids and kept columns."""
    names = ["id", *[f"keep{k}" for k in range(keep)]]
    kinds = [rows.schema[c].dataType for c in names]
    schema = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.ArrayType(t)) for c, t in zip(names, kinds)], *[T.StructField(c, T.BinaryType()) for c in ("dictionary", "sizes", "codes")]])
    most = max(1, min(CHUNK, CHUNK_BYTES // (8 * max(1, width))))

    def run(batches):
        held, count = [], 0

        def close():
            batch = pa.Table.from_batches(held).combine_chunks()
            flat = batch.column("vector").combine_chunks()
            values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), length)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(c).combine_chunks()) for c in names]
            return pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int32()), *lists, *[pa.array([b], pa.binary()) for b in Chunk.of(integers(values, width)).packed()]], [f.name for f in schema])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - count)
                held.append(part)
                count, at = count + part.num_rows, at + part.num_rows
                if count == most:
                    yield close()
                    held, count = [], 0
        if count:
            yield close()

    return rows.where(F.size("vector") == length).select(*names, "vector").mapInArrow(run, schema)


def _read(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            yield one, one.column("n")[0].as_py(), Chunk.read(*(one.column(c)[0].as_py() for c in ("dictionary", "sizes", "codes")))


def _sums(chunks: DataFrame, books: list[np.ndarray]) -> list:
    """(part, entry, position, sum, count) over all vectors; a task sends one row for each entry and position at most."""
    width = books[0].shape[1]

    def run(batches):
        total = np.zeros((len(books), len(books[0]), width), np.int64)
        count = np.zeros((len(books), len(books[0])), np.int64)
        for _, n, chunk in _read(batches):
            for p, book in enumerate(books):
                entry, _ = chunk.nearest(book, p * width, n)
                order = np.argsort(entry, kind="stable")
                used, at = np.unique(entry[order], return_index=True)
                if width:
                    total[p, used] += np.add.reduceat(chunk.values(p * width, width)[order], at, axis=0)
                count[p] += np.bincount(entry, minlength=len(book))
        part, entry = np.nonzero(count)
        made = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(count[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["part", "entry", "position", "total", "n"])

    rows = chunks.drop("id").mapInArrow(run, "part long, entry long, position long, total long, n long")
    return rows.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect()  # of bounded size: entries x dimensions


def _coded(chunks: DataFrame, books: list[np.ndarray], keep: int) -> DataFrame:
    names = ["id", *[f"keep{k}" for k in range(keep)]]
    kinds = [chunks.schema[c].dataType.elementType for c in names]
    schema = T.StructType([*[T.StructField(c, t) for c, t in zip(names, kinds)], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = [to_arrow_type(t) for t in kinds]

    def run(batches):
        for one, n, chunk in _read(batches):
            found = [chunk.nearest(book, p * book.shape[1], n) for p, book in enumerate(books)]
            raw = np.array([entry for entry, _ in found], dtype=np.uint8).T.tobytes().hex()
            step = 2 * len(books)
            code = pa.array([raw[k : k + step] for k in range(0, len(raw), step)], pa.string())
            error = pa.array(sum(d for _, d in found), pa.int64())
            yield pa.RecordBatch.from_arrays([*[one.column(c).flatten().cast(t) for c, t in zip(names, arrow)], code, error], [f.name for f in schema])

    return chunks.mapInArrow(run, schema)


def compress(df: DataFrame, id: str, vector: str, keep: list[str] = [], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(kept rows as id, keep0, keep1, ..., code, error; the codebook of each part). entries: 256 at most, as an index has two hex digits."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = _kept(df, id, vector, keep)
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    length = len(first[0].vector) if first else 0
    width = -(-length // parts) * parts
    seeds = [r.vector for r in rows.where(F.size("vector") == length).select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    start = integers(np.array(seeds, np.float64).reshape(len(seeds), length), width)
    books = np.split(start, parts, axis=1)
    chunks = materialise(_chunks(rows, length, width, len(keep)), "vector-chunks")
    for _ in range(rounds if seeds else 0):
        for r in _sums(chunks, books):
            books[r.part][r.entry, r.position] = int(r.total) // r.n
    return _coded(chunks, books, len(keep)), books


def book_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    # A null label is a group like any other.
    coded = materialise(coded.withColumn("same", F.coalesce(F.col("keep0").cast("string"), F.lit(""))), "vector-codes")
    sums = coded.groupBy("same").agg(F.count("*").alias("n"), F.expr("try_cast(sum(cast(error AS decimal(20,0))) AS bigint)").alias("label_error"))
    judged = join_groups(coded, materialise(sums, "vector-labels"), "same", "n")
    return judged.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def _op11_sql() -> str:
    width = "w"
    sql = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT r, p, v[p * {width} + 1 : (p + 1) * {width}] AS s FROM (SELECT r, v, len(v) // 4 AS {width}, unnest(range(4)) AS p FROM kept)),
book0 AS (SELECT p, r AS e, s AS c FROM parts WHERE r < 256)"""
    for k in range(ROUNDS + 1):
        sql += f""",
near{k} AS MATERIALIZED (
  SELECT r, p, s, min(((list_inner_product(s, s) - 2 * list_inner_product(s, c) + list_inner_product(c, c))::BIGINT) * 256 + e) AS m
  FROM parts JOIN book{k} USING (p) GROUP BY r, p, s)"""
        if k < ROUNDS:
            sql += f""",
sums{k} AS (SELECT p, m % 256 AS e, i, sum(s[i])::BIGINT AS t, count(*) AS n FROM (SELECT p, m, s, unnest(range(1, len(s) + 1)) AS i FROM near{k}) GROUP BY ALL),
made{k} AS (SELECT p, e, list(((t - (((t % n) + n) % n)) // n)::DOUBLE ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN made{k} m USING (p, e))"""
    return (
        sql
        + f""",
digest AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM book{ROUNDS})),
coded AS (SELECT r, string_agg(lower(lpad(to_hex(m % 256), 2, '0')), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"""
    )


OP11_SQL = _op11_sql()
