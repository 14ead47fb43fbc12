"""Assignment, clustering and recognition against enumeration and hand-made cases."""

from itertools import permutations

import tracemalloc

import numpy as np
import pytest

from convlake.functions.assign import Linkage, best_assignment, clusters
from convlake.operators import diarize, speakers


def test_assignment_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        x = np.round(rng.normal(size=(n, m)), 1)
        pairs = best_assignment(x)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        y = x if n <= m else x.T
        best = max(sum(y[i, p[i]] for i in range(len(y))) for p in permutations(range(y.shape[1]), len(y)))
        assert sum(x[i, j] for i, j in pairs) == pytest.approx(best)
    assert best_assignment(np.empty((0, 3))) == []


def around(*angles):
    a = np.radians(angles)
    return np.c_[np.cos(a), np.sin(a)]


def plain_linkage(x):
    """Merge heights from the centroids themselves."""
    nodes, out = [[i] for i in range(len(x))], []
    while len(nodes) > 1:
        d = {(a, b): np.linalg.norm(x[nodes[a]].mean(0) - x[nodes[b]].mean(0)) for a in range(len(nodes)) for b in range(a)}
        a, b = min(d, key=d.get)
        out.append(d[a, b])
        nodes[b] = nodes[b] + nodes.pop(a)
    return out


def test_linkage_heights():
    x = np.random.default_rng(1).normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(Linkage(x).heights, plain_linkage(x))


def test_clusters():
    x = around(0, 2, 4, 90, 92, 95, 180, 1)
    assert clusters(x, 0.3, 2).tolist() == [0, 0, 0, 1, 1, 1, 2, 0]  # a tenth of 8 is one, so one member is enough
    assert clusters(x, 0.3, 2, exact=2).max() == 1
    assert clusters(x, 0.3, 2, high=1).tolist() == [0] * 8
    many = around(*range(0, 20), *range(90, 110), 50)
    assert clusters(many, 0.4, 2).tolist() in ([0] * 20 + [1] * 20 + [0], [0] * 20 + [1] * 20 + [1])
    assert clusters(x[:1], 0.3, 2).tolist() == [0] and clusters(x[:0], 0.3, 2).tolist() == []


def test_windows_to_speakers(spark):
    vec = {"a": [1.0, 0.1], "b": [0.1, 1.0]}
    on, off = [1] * 4, [0] * 4
    rows = [("m", c, local, on if local < 2 else off, vec["ab"[(c + local) % 2]] if (c, local) != (2, 1) else None) for c in range(4) for local in range(3)]
    windows = spark.createDataFrame(rows, "meeting_id string, chunk long, local long, frames array<bigint>, embedding array<double>")
    vectors = diarize.trainable_vectors(windows)
    assert vectors.count() == 7
    cents = diarize.centroids(vectors, diarize.cluster_vectors(vectors, 0.5, 1))
    dealt = {(r["chunk"], r["local"]): r["speaker"] for r in diarize.assign_windows(windows, cents).collect()}
    assert dealt == {(c, k): (c + k) % 2 for c in range(4) for k in range(2) if (c, k) != (2, 1)}
    active = diarize.reconstruct(windows, diarize.assign_windows(windows, cents), 2)
    assert {(r["frame"], r["speaker"]) for r in active.collect()} == {(f, s) for f in range(10) for s in (0, 1)}
    assert diarize.fold_minor_speakers(windows, cents, 2, 16.875).count() == 2


def test_minor_speaker_is_folded(spark):
    rows = [("m", c, 0, [1] * 4, [0.0, 1.0] if c == 50 else [1.0, 0.0]) for c in range(100)]
    windows = spark.createDataFrame(rows, "meeting_id string, chunk long, local long, frames array<bigint>, embedding array<double>")
    cents = spark.createDataFrame([("m", 0, [1.0, 0.0]), ("m", 1, [0.0, 1.0])], "meeting_id string, cluster long, centroid array<double>")
    assert [r["cluster"] for r in diarize.fold_minor_speakers(windows, cents, 4, 16.875).collect()] == [0]
    assert diarize.fold_minor_speakers(windows, cents, 4, 16.875, low=2).count() == 2


SAMPLES = "id long, speaker_id long, model string, embedding array<double>"


def test_recognise(spark):
    library = [(1, 10, "cur", [1.0, 0.0, 0.0]), (2, 20, "cur", [0.0, 1.0, 0.0]), (3, 30, "old", [0.0, 0.0, 1.0]), (4, 20, "cur", None)]
    voices = [("m", "S1", [0.9, 0.1, 0.0]), ("m", "S2", [0.8, 0.0, 0.6]), ("m", "S3", [0.0, 0.2, 1.0]), ("n", "S1", [0.7, 0.7, 0.0]), ("n", "S2", None)]
    samples = spark.createDataFrame(library, SAMPLES)
    for block_bytes in (10**6, 60):  # in one block, and a person to a block
        scores = speakers.match_scores(spark.createDataFrame(voices, "meeting_id string, key string, embedding array<double>"), samples, block_bytes=block_bytes)
        got = {(r[0], r[1]): tuple(r)[2:] for r in speakers.recognise(scores).collect()}
        assert got[("m", "S1")][0] == "auto" and got[("m", "S1")][2] == 10
        assert got[("m", "S3")][0] == "unknown" and got[("m", "S2")] == ("unknown", 0.0, None, None)
        assert got[("n", "S1")][0] == "suggested" and got[("n", "S1")][3] == 10
        assert ("n", "S2") not in got
    assert speakers.match_scores(spark.createDataFrame(voices, "meeting_id string, key string, embedding array<double>"), samples.limit(0)).count() == 0


def brute_scores(voices, people, keep):
    """Every voice with every person: (meeting, key) -> [(person, score)], the best first."""
    out = {}
    for m, k, v in voices:
        x = np.array(v) / np.linalg.norm(v)
        scored = []
        for p, rows in people.items():
            own = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
            centre = own.sum(axis=0) / np.linalg.norm(own.sum(axis=0))
            scored.append((p, 0.6 * float(x @ centre) + 0.4 * float(np.sort(own @ x)[-3:].mean())))
        out[m, k] = sorted(scored, key=lambda s: (-s[1], s[0]))[:keep]
    return out


@pytest.mark.parametrize("keep, blocks, block_bytes", [(3, None, 10**7), (1, 40, 10**7), (500, 6, 10**7), (4, 5, 20_000)])
def test_voices_meet_only_blocks_that_can_count(spark, keep, blocks, block_bytes):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    people = {p: (centres[p % 12] + 0.15 * rng.normal(size=16) + 0.08 * rng.normal(size=(1 + p % 5, 16))).tolist() for p in range(240)}
    samples = spark.createDataFrame([(100 * p + k, p, "cur", v) for p, rows in people.items() for k, v in enumerate(rows)], SAMPLES)
    voices = [(f"m{k % 9}", f"S{k}", (centres[k % 12] + 0.2 * rng.normal(size=16)).tolist()) for k in range(90)]
    counted = []
    got = {}
    found = speakers.match_scores(spark.createDataFrame(voices, "meeting_id string, key string, embedding array<double>"), samples, keep=keep, blocks=blocks, block_bytes=block_bytes, counted=counted)
    for r in found.collect():
        got.setdefault((r[0], r[1]), []).append((r["speaker_id"], r["score"]))
    want = brute_scores(voices, people, keep)
    for voice, scored in want.items():
        mine = sorted(got[voice], key=lambda s: (-s[1], s[0]))
        assert [p for p, _ in mine] == [p for p, _ in scored] and np.allclose([s for _, s in mine], [s for _, s in scored])
    assert counted[1] == 240 * 90
    if keep < 4:
        assert counted[0] < 0.3 * counted[1]


def greedy(left, most):
    while len(left) > most:
        del left[max(left, key=lambda i: (max(left[i] @ left[j] for j in left if j != i).round(12), -i))]
    return set(left)


@pytest.mark.parametrize("block", [4096, 4])
def test_prune(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3 if i < 60 else 9, "cur", rng.normal(size=4).tolist()) for i in range(65)]
    rows += [(100 + i, 0, "old", rows[0][3]) for i in range(4)] + [(200 + i, 0, "cur", rows[30][3]) for i in range(3)] + [(300, 0, "cur", None)]
    got = {}
    for r in speakers.prune(spark.createDataFrame(rows, SAMPLES), 8, block=block).collect():
        got.setdefault(r["speaker_id"], set()).add(r["id"])
    assert got[9] == {60, 61, 62, 63, 64}
    for p in range(3):
        want = greedy({i: np.array(v) / np.linalg.norm(v) for i, s, m, v in rows if s == p and m == "cur" and v}, 8)
        assert got[p] == want | ({100, 101, 102, 103, 300} if p == 0 else set())


def test_thinning_holds_no_matrix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    places = np.arange(len(x))
    best, at = speakers._later_best(x, places, x, places)
    small = speakers._later_best(x[:150], places[:150], x[:150], places[:150])
    assert set(speakers._thinned(x[:150], *small, 20).tolist()) == greedy(dict(enumerate(x[:150])), 20)
    tracemalloc.start()
    left = speakers._thinned(x, best, at, 15_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(left) == 15_000 and peak < 8 * x.nbytes


def test_library_meetings_and_voiceprints(spark):
    people = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    samples = spark.createDataFrame([(1, 1, "cur", 0, 1000, "m1"), (2, 1, "old", 0, 500, "m9")], "id long, speaker_id long, model string, start_ms long, end_ms long, meeting_id string")
    heard = spark.createDataFrame([("m1", 1), ("m2", 1), ("m2", 1), ("m3", 2), ("m4", None)], "meeting_id string, speaker_id long")
    got = {r["speaker_id"]: tuple(r)[2:] for r in speakers.library_stats(people, samples, heard).collect()}
    assert got == {1: (2, 1500, 1, 2), 2: (0, 0, 0, 1)}
    turns = [("m", "S1", 0, 9000, None)] + [("m", "S1", 10000 * k, 10000 * k + 8000 - k, [1.0, 0.0]) for k in range(1, 8)] + [("m", "S1", 90000, 92000, [0.0, 1.0])]
    print_ = speakers.voiceprints(spark.createDataFrame(turns, "meeting_id string, key string, start_ms long, end_ms long, embedding array<double>")).first()["voiceprint"]
    assert print_ == [1.0, 0.0]  # the longest turn has no vector, and still one of the eight places
