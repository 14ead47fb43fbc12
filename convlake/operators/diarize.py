"""Speaker activity on frames: windows, votes, turns, waveforms (D)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.assign import best_assignment, clusters
from convlake.functions.columns import unit
from convlake.functions.written import written

# Samples from frame to frame, those that a frame sees, and a second's.
FRAME_STEP, FRAME_SIZE, RATE = 270, 991, 16000
JOIN_FRAMES = 5
LEAST_FRAMES = 6


def sliding_windows(recordings: DataFrame, size: int, step: int) -> DataFrame:
    """D1. Starts of windows of `size` over `samples`, every `step`, with a last one for what is left."""
    whole = f"if(samples < {size}, cast(0 AS bigint), (samples - {size}) div {step} + 1)"
    rows = recordings.selectExpr("meeting_id", "samples", f"{whole} AS whole")
    rest = f"if(whole = 0, true, (whole - 1) * {step} + {size} < samples)"
    return rows.withColumn("chunk", F.explode(F.expr(f"sequence(0L, whole - if({rest}, 0, 1))"))).selectExpr("meeting_id", "chunk", f"chunk * {step} AS start")


def frames_to_turns(active: DataFrame, join: int = JOIN_FRAMES, least: int = LEAST_FRAMES) -> DataFrame:
    """D9. Spans of active frames of a speaker: gaps of at most `join` frames are closed, then spans under `least` frames go. First and
    last frame, and start_s and end_s in seconds: from the middle between a frame's centre and the one before it, never below 0, rounded to ms."""
    rows = active.select("meeting_id", "speaker", "frame").distinct()
    rows = rows.selectExpr("*", f"coalesce(frame - lag(frame) OVER (PARTITION BY meeting_id, speaker ORDER BY frame) - 1 > {join}, true) AS starts")
    rows = rows.selectExpr("*", "sum(cast(starts AS bigint)) OVER (PARTITION BY meeting_id, speaker ORDER BY frame ROWS UNBOUNDED PRECEDING) AS span")
    spans = rows.groupBy("meeting_id", "speaker", "span").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    spans = spans.where(f"last - first + 1 >= {least}")
    at = lambda frame: f"({frame}) * {FRAME_STEP}D / {RATE} + {FRAME_SIZE}D / {2 * RATE} - {FRAME_STEP}D / {2 * RATE}"
    return spans.selectExpr("meeting_id", "speaker", "first", "last", f"round(greatest(0D, {at('first')}), 3) AS start_s", f"round({at('last + 1')}, 3) AS end_s")


def order_speakers(turns: DataFrame) -> DataFrame:
    """D11. Speakers renumbered from 1 by their first appearance (the smaller speaker on ties)."""
    first = turns.groupBy("meeting_id", "speaker").agg(F.min("first").alias("at"))
    return first.selectExpr("meeting_id", "speaker", "cast(row_number() OVER (PARTITION BY meeting_id ORDER BY at, speaker) AS bigint) AS number")


def waveform_peaks(samples: DataFrame, bucket: int) -> DataFrame:
    """D13. 0 to 100 per bucket: the largest absolute value over the recording's 99.5th percentile, to the power 0.7."""
    peaks = samples.groupBy("meeting_id", F.expr(f"idx div {bucket}").alias("bucket")).agg(F.max(F.expr("abs(value)")).alias("peak"))
    scale = peaks.groupBy("meeting_id").agg(F.expr("percentile(peak, 0.995D)").alias("scale"))
    level = "if(scale > 0, cast(bround(100 * least(1D, pow(peak / scale, 0.7D))) AS bigint), 0L)"
    return peaks.join(scale, "meeting_id").selectExpr("meeting_id", "bucket", f"{level} AS level")


def loudness(samples: DataFrame, rate: float) -> DataFrame:
    """D13. Duration in seconds and root mean square of each recording; values beyond -1..1 count as that."""
    level = "greatest(-1D, least(1D, cast(value AS double)))"
    return samples.groupBy("meeting_id").agg((F.count("*") / F.lit(float(rate))).alias("duration_s"), F.sqrt(F.avg(F.expr(f"{level} * {level}"))).alias("rms"))


def speaking_time(active: DataFrame, frame_ms: int) -> DataFrame:
    """D12. Milliseconds that each speaker is active, from the frames."""
    return active.select("meeting_id", "speaker", "frame").distinct().groupBy("meeting_id", "speaker").agg((F.count("*") * frame_ms).alias("ms"))


MOST_VECTORS = 4000
LOCALS = 3


def frame_counts(windows: DataFrame, step: int) -> DataFrame:
    """D2. Speakers at a time per frame: the mean over the windows that cover it, halves to the even number. windows:
    meeting_id, chunk, local, frames (0 or 1 for each frame of the window)."""
    rows = windows.select("meeting_id", "chunk", F.posexplode("frames").alias("f", "on"))
    rows = rows.groupBy("meeting_id", "chunk", F.expr(f"chunk * {step} + f").alias("frame")).agg(F.sum("on").alias("on"))
    return rows.groupBy("meeting_id", "frame").agg(F.expr("cast(bround(sum(on) / count(*)) AS bigint)").alias("speakers"))


def active_vectors(windows: DataFrame) -> DataFrame:
    """All vectors (meeting_id, chunk, local, vector), scaled to length 1, of the local speakers that are active."""
    return windows.where("embedding IS NOT NULL AND exists(frames, f -> f > 0)").select("meeting_id", "chunk", "local", unit("embedding").alias("vector"))


def trainable_vectors(windows: DataFrame, most: int = MOST_VECTORS) -> DataFrame:
    """D3. Vectors, scaled to length 1, of the local speakers that are active; of over `most` in a meeting, `most` evenly spaced."""
    rows = active_vectors(windows).selectExpr("*", "row_number() OVER (PARTITION BY meeting_id ORDER BY chunk, local) - 1 AS place", "count(*) OVER (PARTITION BY meeting_id) AS n")
    # Place p is picked if a step of the even spacing rounds to it.
    near = f"cast(round(place * ({most} - 1D) / greatest(1, n - 1)) AS bigint)"
    hit = f"exists(array(-1, 0, 1), o -> {near} + o BETWEEN 0 AND {most} - 1 AND bround(({near} + o) * (n - 1) / ({most} - 1D)) = place)"
    return rows.where(f"n <= {most} OR {hit}" if most > 1 else "place = 0").select("meeting_id", "chunk", "local", "vector")


def cluster_vectors(vectors: DataFrame, threshold: float, least: int, low: int = 1, high: int = 20, exact: int | None = None) -> DataFrame:
    """D4 and D5. The cluster (from 0) of each vector of a meeting. A meeting's vectors, MOST_VECTORS at most, make one group."""
    kind = vectors.schema["meeting_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["chunk", "local"], ignore_index=True)
        labels = clusters(np.vstack(group["vector"].to_list()), threshold, least, low, high, exact)
        return group[["meeting_id", "chunk", "local"]].assign(cluster=labels)

    return vectors.groupBy("meeting_id").applyInPandas(run, f"meeting_id {kind}, chunk long, local long, cluster long")


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(meeting_id, cluster, centroid): the normalised mean of each cluster's vectors."""
    rows = vectors.join(labels, ["meeting_id", "chunk", "local"]).select("meeting_id", "cluster", F.posexplode("vector").alias("dim", "x"))
    sums = rows.groupBy("meeting_id", "cluster", "dim").agg(F.sum("x").alias("x")).groupBy("meeting_id", "cluster")
    return sums.agg(F.expr("transform(array_sort(collect_list(struct(dim, x))), v -> v.x)").alias("total")).select("meeting_id", "cluster", unit("total").alias("centroid"))


def merge_by_anchors(cents: DataFrame, matches: DataFrame, threshold: float, low: int = 1) -> DataFrame:
    """D6. Clusters of a meeting whose best known voice (meeting_id, cluster, speaker_id, score) is the same and reaches the
    threshold become one, with the normalised mean of their centroids, unless that merge alone left fewer than `low`."""
    best = matches.groupBy("meeting_id", "cluster").agg(F.expr("min_by(struct(speaker_id, score), struct(-score, speaker_id))").alias("b"))
    rows = cents.join(best.where(F.col("b.score") >= threshold), ["meeting_id", "cluster"], "left")
    rows = rows.withColumn("who", F.expr("coalesce(cast(b.speaker_id AS string), concat('#', cluster))"))
    same = "OVER (PARTITION BY meeting_id, who)"
    left = f"count(*) OVER (PARTITION BY meeting_id) - count(*) {same} + 1"
    rows = rows.selectExpr("meeting_id", f"if({left} < {low}, cluster, min(cluster) {same}) AS cluster", "centroid")
    parts = rows.select("meeting_id", "cluster", F.posexplode("centroid").alias("dim", "x")).groupBy("meeting_id", "cluster", "dim").agg(F.sum("x").alias("x"))
    total = parts.groupBy("meeting_id", "cluster").agg(F.expr("transform(array_sort(collect_list(struct(dim, x))), v -> v.x)").alias("total"))
    return total.select("meeting_id", "cluster", unit("total").alias("centroid"))


def assign_windows(windows: DataFrame, cents: DataFrame) -> DataFrame:
    """D7. (meeting_id, chunk, local, speaker): the local speakers of a window, three at most, go to different clusters for the
    greatest total cosine. Those without activity or vector get none. A row holds one window and its meeting's centroids."""
    active = windows.where("embedding IS NOT NULL AND exists(frames, f -> f > 0)").select("meeting_id", "chunk", "local", unit("embedding").alias("v"))
    seen = active.groupBy("meeting_id", "chunk").agg(F.expr("array_sort(collect_list(struct(local, v)))").alias("own"))
    known = cents.groupBy("meeting_id").agg(F.expr("array_sort(collect_list(struct(cluster, centroid)))").alias("known"))
    kind = windows.schema["meeting_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for meeting, chunk, own, known in batch.itertuples(index=False, name=None):
                x, c = np.vstack([o["v"] for o in own]), np.vstack([k["centroid"] for k in known])
                rows += [(meeting, chunk, own[i]["local"], known[j]["cluster"]) for i, j in best_assignment(x @ c.T)]
            yield pd.DataFrame(rows, columns=["meeting_id", "chunk", "local", "speaker"])

    return seen.join(known, "meeting_id").select("meeting_id", "chunk", "own", "known").mapInPandas(run, f"meeting_id {kind}, chunk long, local long, speaker long")


def reconstruct(windows: DataFrame, assigned: DataFrame, step: int, frames: DataFrame | None = None) -> DataFrame:
    """D8. Active (meeting_id, frame, speaker): as many speakers per frame as D2 says, those with most votes (the smaller
    speaker on ties); a window votes once for a speaker. frames (meeting_id, frames) cuts what is past the recording's end."""
    rows = windows.join(assigned, ["meeting_id", "chunk", "local"]).select("meeting_id", "chunk", "speaker", F.posexplode("frames").alias("f", "on"))
    votes = rows.where("on > 0").select("meeting_id", "chunk", F.expr(f"chunk * {step} + f").alias("frame"), "speaker").distinct()
    votes = votes.groupBy("meeting_id", "frame", "speaker").agg(F.count("*").alias("votes"))
    places = votes.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id, frame ORDER BY votes DESC, speaker) AS place")
    out = places.join(frame_counts(windows, step), ["meeting_id", "frame"]).where("place <= speakers").select("meeting_id", "frame", "speaker")
    return out.join(frames, "meeting_id").where("frame < frames").select("meeting_id", "frame", "speaker") if frames is not None else out


def fold_minor_speakers(windows: DataFrame, cents: DataFrame, step: int, frame_ms: float, low: int = 1, rounds: int = 3) -> DataFrame:
    """D10. Centroids without those of speakers that talk under 3 % of all, or a minute if that is less; what they had is dealt
    again, up to three times, never below `low` speakers. Each round's centroids are written, so that the next reads them."""
    for _ in range(rounds):
        cents = written(cents, "centroids")
        active = reconstruct(windows, assign_windows(windows, cents), step)
        talk = active.groupBy("meeting_id", F.col("speaker").alias("cluster")).agg((F.count("*") * frame_ms).alias("ms"))
        rows = cents.join(talk, ["meeting_id", "cluster"], "left").selectExpr("*", "coalesce(ms, 0D) AS talk")
        rows = rows.selectExpr("meeting_id", "cluster", "centroid", "talk < least(60000D, 0.03D * sum(talk) OVER (PARTITION BY meeting_id)) AS minor")
        kept = f"count_if(NOT minor) OVER (PARTITION BY meeting_id) >= {max(1, low)}"
        cents = rows.selectExpr("*", f"{kept} AS enough").where("NOT (minor AND enough)").select("meeting_id", "cluster", "centroid")
    return cents
