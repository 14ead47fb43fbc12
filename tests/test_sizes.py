"""Queries against their SQL on made tables with groups larger than those of the given ones."""

import time
from collections import Counter

import duckdb
import numpy as np

import __spark_entry__ as entry
from convlake.operators import speakers


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL on tables written to the folder."""
    con = duckdb.connect()
    for t, rows in tables.items():
        spark.createDataFrame(*rows).repartition(3).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    return Counter(tuple(r) for r in got.collect()), Counter(tuple(r[i] for i in at) for r in want.fetchall())


def voices(n, seed, step, near=0.0):
    """embeddings of n vectors around ten people, every `step` ids from 1 on; the nearer to 1 `near` is, the more alike."""
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 10, n)
    x = near * rng.normal(size=(10, 64))[label] + (1 - near) * rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    return list(zip((1 + np.arange(n) * step).tolist(), x.tolist(), label.tolist())), "vec_id long, embedding array<float>, label int"


def test_anchors_meet_all_vectors_of_a_meeting(spark, tmp_path):
    rows = voices(5000, 5, step=10)  # one meeting; six of seven have a vector, more than D4 clusters at once
    got, want = both(spark, tmp_path, "d6_merge_by_anchors", embeddings=rows)
    assert sum(got.values()) > 1 and got == want


def test_recordings_stay_whole_when_their_join_becomes_a_broadcast(spark, tmp_path):
    rows = [(i, i * 7 % 20, '{"k": %d}' % (i * i % 101)) for i in range(30_000)]  # 20 recordings of about 9 parts each
    # The files are larger than 10k, what is joined of them is not: Spark finds that out as it runs. Small shuffles keep several tasks.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k in conf:
            spark.conf.set(k, conf[k])
        got, want = both(spark, tmp_path, "s7_assemble_recordings", events=(rows, "event_id long, user_id long, props string"))
    finally:
        for k in conf:
            spark.conf.set(k, before[k])
    assert len(got) == 20 and got == want


def test_decisions_are_carried_within_a_large_meeting_in_time(spark, tmp_path):
    (rows, kind), began = voices(12_000, 7, step=25, near=0.7), time.time()
    rows = [(i, rows[k % 11_000][1], p) for k, (i, _, p) in enumerate(rows)]  # the last thousand repeat vectors
    got, want = both(spark, tmp_path, "l10_carry_decisions", embeddings=(rows, kind))
    assert len(got) > 6000 and got == want
    assert time.time() - began < 60  # 72 million pairs: a join row by row takes minutes


def test_carried_decisions_by_blocks_and_by_join(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 4)), 1)
    x[60:] = x[:30]
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1.0, 0.5], [1.0, 0.6, 0.1]]
    rows = [(f"m{k % 4}", f"k{k}", ("named", "confirmed", "auto")[k % 3], v) for k, v in enumerate([*x.tolist(), *odd, *odd, *odd])] + [(None, "k", "named", [1.0] * 4), ("m0", None, "named", x[4].tolist())]
    old = spark.createDataFrame(rows, "meeting_id string, key string, status string, embedding array<double>")
    new = spark.createDataFrame([r for r in rows if r[1] != "k7"], old.schema).drop("status")
    by_join = speakers.carry_decisions(new, old, 0.8, few=10**9).collect()
    assert len(by_join) > 40 and sorted(by_join, key=repr) == sorted(speakers.carry_decisions(new, old, 0.8, few=0, block=5).collect(), key=repr)
    sound = {(m, k): v for m, k, _, v in rows if m and v and None not in v and np.isfinite(v).all()}
    told = {(m, k) for m, k, s, _ in rows if s != "auto"}
    for m, k, old_key, status, likeness in by_join:
        v = np.array(sound[m, k])
        alike = {o: v @ sound[m, o] / np.linalg.norm(v) / max(1e-12, np.linalg.norm(sound[m, o])) for n, o in sound if n == m and (m, o) in told and len(sound[m, o]) == len(v)}
        best = max(alike.values())
        assert abs(likeness - best) < 1e-12 and old_key == min((o for o in alike if best - alike[o] < 1e-12), key=lambda o: (o is not None, o or ""))
        assert (m, old_key, status) in {r[:3] for r in rows}
