"""Vector codes and exact deduplication against plain restatements, with the odd cases."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.llm import common, exactdup, vectorcode

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, entries=256):
    """Lloyd's rounds with whole differences; rows: (id, label, integers) in order."""
    values = np.array([v for *_, v in rows], dtype=np.int64)
    parts = np.split(values, 4, axis=1)
    books = [p[:entries].copy() for p in parts]

    def near(p, book):
        d = ((p[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(4):
        for p, book in zip(parts, books):
            e, _ = near(p, book)
            for k in set(e.tolist()):
                book[k] = [int(s) // int((e == k).sum()) for s in p[e == k].sum(axis=0)]
    found = [near(p, b) for p, b in zip(parts, books)]
    errors = sum(d for _, d in found)
    by_label = defaultdict(int)
    for (_, label, _), e in zip(rows, errors.tolist()):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return [(i, "".join(f"{int(e[k]):02x}" for e, _ in found), int(errors[k]), by_label[label], digest) for k, (i, label, _) in enumerate(rows)]


def coded(spark, df, tmp):
    df.write.parquet(f"{tmp}/embeddings.parquet")
    return vectorcode.op11_vector_codes(spark, str(tmp))


@pytest.mark.parametrize("chunk", [4096, 7])
def test_codes_against_plain_rounds(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(vectorcode, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.2, (40, 8))
    rows = [(int(k * 3 % 701), (base[k % 40] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist(), None if k % 5 == 0 else k % 3) for k in range(700)]
    rows += [rows[9]] * 40 + [(None, [0.5] * 8, None)]
    odd = [(1, None, 1), (2, [0.1] * 7 + [None], 1), (3, [NAN] + [0.0] * 7, 1), (4, [INF] * 8, 2), (5, [-INF] + [1.0] * 7, 2), (900, [1.0] * 5, 1), (901, [], 1)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumn("id", F.lit("x")).withColumn("keep0", F.lit(1)).repartition(5)
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = plain_codes([(i, label, [int(np.floor(1024 * x)) for x in v]) for i, v, label in kept])
    got = [tuple(r) for r in coded(spark, df, tmp_path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_codes_of_few_odd_and_no_vectors(spark, tmp_path):
    few = spark.createDataFrame([(1, [0.5, -0.5, 1e30, 2.0, 3.0], 1), (2, [0.5, -0.5, 1e30, 2.0, 3.0], None)], VECTORS)
    rows = coded(spark, few, tmp_path / "a").collect()
    assert [(r.code, r.error) for r in rows] == [("00000000", 0)] * 2
    assert coded(spark, few.limit(0), tmp_path / "b").count() == 0
    none = spark.createDataFrame([(1, None, 1), (2, [NAN], 1)], VECTORS)
    assert coded(spark, none, tmp_path / "c").count() == 0


def test_tables_of_differences_give_distances():
    rng = np.random.default_rng(4)
    for high in (50, 1 << 26):
        values, book = rng.integers(-high, high, (1300, 6)), rng.integers(-high, high, (256, 3))
        book[7] = book[3]
        chunk = vectorcode.Chunk.read(*vectorcode.Chunk.of(values).packed())
        entry, distance = chunk.nearest(book, 3, 1300)
        d = ((values[:, None, 3:] - book[None]) ** 2).sum(axis=2)
        assert (entry == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


# 12 -------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string"
ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a  b\n"), (6, "a  b\n"), (7, "A b"), (8, "a b"), (9, "日本 語"), (10, "日本語"), (None, "ab\n\n\n"), (None, "ab\n\n\n"),
    (11, "x" * 300_000), (12, "x " * 300_000), (13, "a\x00b"), (14, "a b\x00"),
] + [(100 + k, "hot " * (k % 3)) for k in range(600)] + [(1000 + k, f"only {k}") for k in range(3000)]


def plain_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    out = []
    for key, members in by.items():
        order = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        digest = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, order[0][0], len(order), k == 0, digest) for k, (i, _) in enumerate(order)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], DOCS).withColumn("key", F.lit(1)).withColumn("row", F.lit("x")).withColumn("size", F.lit(2)).repartition(6)


@pytest.mark.parametrize("filter_bytes", [exactdup.FILTER_BYTES, 1])
def test_groups_of_equal_texts(rows, filter_bytes):
    assert sorted((tuple(r) for r in exactdup.groups(rows, filter_bytes=filter_bytes).collect()), key=repr) == plain_groups(ROWS)


def test_one_whole_row_of_each_group_stays(rows):
    want = sorted(((r[0], r[4]) for r in plain_groups(ROWS) if r[3]), key=repr)
    kept = exactdup.deduplicate(rows)
    assert kept.columns == rows.columns
    got = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == want
    assert exactdup.deduplicate(rows.limit(0)).count() == 0 and exactdup.groups(rows.limit(0)).count() == 0


def test_filter_clears_most_rows_that_are_alone(spark):
    keys = common.materialise(spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key")).unionAll(spark.range(50).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))), "test-keys")
    bits, buckets = exactdup.build(keys, "key")
    asked = exactdup.probe(keys, "key", bits, buckets)
    assert 100 <= asked.where("_dedup_possible").count() < 1500
    plan = exactdup.probe(keys, "key", bits, buckets)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
