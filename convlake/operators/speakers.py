"""The voice library: profiles, quality, matches (L)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from convlake.functions.assign import best_assignment
from convlake.functions.columns import dot, unit
from convlake.functions.written import written
from convlake.operators.align import numbered_turns

BEFORE, AFTER = 20, 19
MOST_TURNS = 16
LEAST_TURN_MS, MOST_CLIP_MS = 2500, 12000


def _sums(samples: DataFrame, model: str) -> DataFrame:
    """Per person the number of samples of the model and the sum of their unit vectors, dimension by dimension."""
    rows = samples.where(F.col("model") == model).select("speaker_id", F.posexplode(unit("embedding")).alias("dim", "x"))
    sums = rows.groupBy("speaker_id", "dim").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy("speaker_id").agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(dim, x))), v -> v.x)").alias("total"))


def profiles(samples: DataFrame, model: str = "cur") -> DataFrame:
    """L1. Each person's centroid: the normalised mean of the normalised vectors of one model."""
    return _sums(samples, model).select("speaker_id", "n", unit("total").alias("centroid"))


def library_stats(speakers: DataFrame, samples: DataFrame, meeting_speakers: DataFrame, model: str = "cur") -> DataFrame:
    """L2. Samples, their time, those of the current model, and the distinct meetings in which meeting_speakers has each person."""
    own = samples.groupBy("speaker_id").agg(F.count("*").alias("samples"), F.sum(F.expr("end_ms - start_ms")).alias("ms"), F.count_if(F.col("model") == model).alias("current"))
    heard = meeting_speakers.where("speaker_id IS NOT NULL").select("speaker_id", "meeting_id").distinct().groupBy("speaker_id").agg(F.count("meeting_id").alias("meetings"))
    rows = speakers.withColumnRenamed("id", "speaker_id").join(own, "speaker_id", "left").join(heard, "speaker_id", "left")
    return rows.selectExpr("speaker_id", "name", *[f"coalesce({c}, 0L) AS {c}" for c in ("samples", "ms", "current", "meetings")])


def consistency(samples: DataFrame, model: str = "cur") -> DataFrame:
    """L3. Mean cosine between a person's samples, from the length of their sum; null with one sample."""
    return _sums(samples, model).select("speaker_id", F.expr("if(n < 2, NULL, (aggregate(total, 0D, (s, x) -> s + x * x) - n) / (n * (n - 1)))").alias("consistency"))


def strength(stats: DataFrame, consistencies: DataFrame) -> DataFrame:
    """L4. none, weak, strong or good, from samples of the current model and their time."""
    rows = stats.join(consistencies, "speaker_id", "left")
    rule = "CASE WHEN current = 0 THEN 'none' WHEN current < 3 OR ms < 15000 THEN 'weak' WHEN current >= 8 AND ms >= 60000 AND (consistency IS NULL OR consistency > 0.45D) THEN 'strong' ELSE 'good' END"
    return rows.selectExpr("speaker_id", f"{rule} AS strength")


def sample_details(samples: DataFrame, meetings: DataFrame, model: str = "cur", least: float = 0.48) -> DataFrame:
    """L5. Every sample with the title of its meeting, whether it is of the model, its cosine with the sum of the person's other
    samples of the model, and whether that is below `least`. Samples of other models, and of people with under 3 of the model,
    have no score and are no outliers."""
    own = samples.where(F.col("model") == model).select("id", "speaker_id", unit("embedding").alias("v"))
    own = own.join(_sums(samples, model).where("n >= 3"), "speaker_id").withColumn("rest", F.expr("zip_with(total, v, (t, x) -> t - x)"))
    scores = own.select("id", (dot("v", "rest") / F.sqrt(dot("rest", "rest"))).alias("score"))
    rows = samples.select("id", "speaker_id", "meeting_id", (F.col("model") == model).alias("active")).join(scores, "id", "left")
    rows = rows.join(meetings.selectExpr("id AS meeting_id", "title"), "meeting_id", "left")
    return rows.select("id", "speaker_id", "meeting_id", "title", "active", "score", F.coalesce(F.col("score") < least, F.lit(False)).alias("outlier"))


def reembed_worklist(samples: DataFrame, model: str) -> DataFrame:
    """L15. (speaker_id, clip, id) of the clips of which a person has samples of other models and none of this one; the
    smallest id of them. Samples without a clip can't be computed again."""
    have = samples.where(F.col("model") == model).select("speaker_id", "clip")
    other = samples.where((F.col("model") != model) & F.col("clip").isNotNull()).join(have, ["speaker_id", "clip"], "left_anti")
    return other.groupBy("speaker_id", "clip").agg(F.min("id").alias("id"))


def merge_speakers(samples: DataFrame, meeting_speakers: DataFrame, people: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L18. Samples, meeting_speakers and people once people (source) became others (target, none a source): ids are rewritten
    in matches and suggestions too, and sources go. The samples of targets are pruned by L6."""
    moved = mapping.where("source <> target").select("source", "target").distinct()

    def over(rows: DataFrame, name: str) -> DataFrame:
        to = moved.select(F.col("source").alias(name), F.col("target").alias(f"_{name}"))
        return rows.join(to, name, "left").withColumn(name, F.coalesce(f"_{name}", name)).select(*rows.columns)

    matched = over(over(meeting_speakers, "speaker_id"), "suggested_id")
    return over(samples, "speaker_id"), matched, people.join(moved.select(F.col("source").alias("id")), "id", "left_anti").select(*people.columns)


def merge_meeting_keys(meeting_speakers: DataFrame, segments: DataFrame, turns: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L20. Talk times (meeting_id, key, talk_ms), segments and turns (meeting_id, speaker) with the keys of a meeting (source)
    moved to others (target); the source's row goes."""
    moved = mapping.where("source <> target").select("meeting_id", "source", "target").distinct()

    def over(rows: DataFrame, name: str) -> DataFrame:
        to = moved.select("meeting_id", F.col("source").alias(name), F.col("target").alias("_target"))
        return rows.join(to, ["meeting_id", name], "left").withColumn(name, F.coalesce("_target", name)).select(*rows.columns)

    return over(meeting_speakers, "key").groupBy("meeting_id", "key").agg(F.sum("talk_ms").alias("talk_ms")), over(segments, "speaker"), over(turns, "speaker")


def turn_overlap(turns: DataFrame) -> DataFrame:
    """L11. Per turn the milliseconds that other speakers talk over it, among the 20 turns before and 19 after.
    Turns are met by number, so a row meets at most 39 others."""
    known = numbered_turns(turns)
    tried = known.withColumn("o", F.explode(F.expr(f"sequence(k - {BEFORE}, k + {AFTER})")))
    others = known.selectExpr("meeting_id", "k AS o", "speaker AS other", "ts AS other_ts", "te AS other_te")
    both = "if(other <> speaker, greatest(0L, least(te, other_te) - greatest(ts, other_ts)), 0L)"
    return tried.join(others, ["meeting_id", "o"]).groupBy("meeting_id", "k", "speaker", "ts", "te").agg(F.sum(F.expr(both)).alias("overlap_ms"))


def sample_candidates(overlaps: DataFrame, samples: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """L12. Clips to learn a voice from: the longest turns of each speaker (the earlier on ties) that last 2.5 s, are
    overlapped for a quarter at most and begin a second or more from any sample (meeting_id, speaker, start_ms);
    of each its middle, 12 s at most."""
    fit = overlaps.where(f"te - ts >= {LEAST_TURN_MS} AND overlap_ms * 4 <= te - ts")
    fit = fit.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY te - ts DESC, k) AS place").where(f"place <= {most}")
    have = samples.selectExpr("meeting_id AS m", "speaker AS s", "start_ms AS taken")
    new = fit.join(have, F.expr("meeting_id = m AND speaker = s AND abs(taken - ts) < 1000"), "left_anti")
    clip = f"least(te - ts, {MOST_CLIP_MS})"
    return new.selectExpr("meeting_id", "speaker", "k", f"greatest(0D, (ts + te - {clip}) / 2D) AS clip_start", f"(ts + te + {clip}) / 2D AS clip_end")


def enroll_pieces(recordings: DataFrame, piece: int, least: int) -> DataFrame:
    """L19. Pieces of a recording (meeting_id, samples): `piece` samples each, a last one only from `least` on."""
    rows = recordings.withColumn("start", F.explode(F.expr(f"sequence(0L, greatest(1L, samples - {least}) - 1, cast({piece} AS bigint))")))
    return rows.selectExpr("meeting_id", "start", f"least(start + {piece}, samples) AS stop").where(f"stop - start >= {least}")


def voiceprints(turn_vectors: DataFrame, most: int = 8, least_ms: int = 1500) -> DataFrame:
    """L7. Per (meeting_id, key) the normalised sum of the vectors of its longest turns (the earlier on ties), each
    weighted by its length, 10 s at most; a turn without a vector takes its place all the same; turns under `least_ms` count only where a speaker has no other."""
    rows = turn_vectors.selectExpr("meeting_id", "key", "start_ms", "end_ms - start_ms AS ms", "embedding")
    who = "PARTITION BY meeting_id, key"
    rows = rows.selectExpr("*", f"row_number() OVER ({who} ORDER BY ms DESC, start_ms) AS place", f"max(ms) OVER ({who}) AS longest")
    rows = rows.where(f"embedding IS NOT NULL AND place <= {most} AND (ms >= {least_ms} OR longest < {least_ms})")
    parts = rows.select("meeting_id", "key", F.expr("least(ms, 10000) / 1000D").alias("weight"), F.posexplode("embedding").alias("dim", "x"))
    sums = parts.groupBy("meeting_id", "key", "dim").agg(F.sum(F.expr("weight * x")).alias("x"))
    total = sums.groupBy("meeting_id", "key").agg(F.expr("transform(array_sort(collect_list(struct(dim, x))), v -> v.x)").alias("total"))
    return total.select("meeting_id", "key", unit("total").alias("voiceprint"))


FEW_PAIRS, CARRY_BLOCK = 4096, 8192
NEAR = 1e-9  # of products of matrices to sums in order, for rounding


def _columns(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as doubles, a row of the result for each place in them."""
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks])
    return np.ascontiguousarray(values.astype(np.float64).reshape(len(lists), -1).T)


def _summed(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Inner products of the pairs (i, j) of two results of _columns, in order of the places, so that equal vectors give equal ones."""
    return sum((x[i] * y[j] for x, y in zip(a, b)), 0.0)


def _most_alike(own: np.ndarray, held: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, held vector, cosine) of the held vector most like each of the own ones, above least; the first on ties. Products of matrices
    leave those that may be best, of which the sums decide. Of equal held vectors only the first is met."""
    rows = np.ascontiguousarray(held.T)
    first = np.sort(np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_index=True)[1])
    held = held[:, first]
    size, sizes = (np.maximum(1e-12, np.sqrt(_summed(x, x))) for x in (own, held))
    units, others = np.ascontiguousarray((own / size).T), held / sizes
    found = []
    for at in range(0, own.shape[1], PROBES_AT_ONCE):
        sims = units[at : at + PROBES_AT_ONCE] @ others
        row, col = np.nonzero(sims >= np.maximum(sims.max(axis=1), least)[:, None] - NEAR)
        alike = _summed(own, held, at + row, col) / size[at + row] / sizes[col]
        order = np.lexsort((col, -alike, row))
        order = order[np.unique(row[order], return_index=True)[1]]
        order = order[alike[order] > least]
        found.append((at + row[order], first[col[order]], alike[order]))
    row, col, alike = (np.concatenate(c) for c in zip(*found))
    return row, col, alike


def carry_decisions(new: DataFrame, old: DataFrame, least: float = 0.85, few: int = FEW_PAIRS, block: int = CARRY_BLOCK) -> DataFrame:
    """L10. For each new voice (meeting_id, key, embedding) the old one of its meeting that a user decided on and that is
    most alike, above `least`; the smaller old key on ties. Vectors with nulls or other than finite components are like none.

    Exact, over all pairs of a meeting. Where these are over `few`, both sides are dealt into blocks of about `block` voices and a task
    meets a pair of blocks by products of matrices, so a meeting may have any size; the work still grows with its pairs."""
    sound = "meeting_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('infinity'))"
    voices = new.where(sound).selectExpr("meeting_id", "key", "embedding AS v", "size(embedding) AS dims")
    decided = old.where(f"status IN ('confirmed', 'named') AND {sound}").selectExpr("meeting_id", "key AS old_key", "status", "embedding AS w", "size(embedding) AS dims")
    by = ["meeting_id", "dims"]
    sizes = voices.groupBy(by).agg(F.count("*").alias("n")).join(decided.groupBy(by).agg(F.count("*").alias("m")), by)
    sizes = written(sizes.selectExpr(*by, f"n * m <= {few} AS small", f"n div {block} + 1 AS own", f"m div {block} + 1 AS held"), "voice-sizes")

    met = voices.join(sizes.where("small").select(*by), by).join(decided, by)
    length = lambda v: F.greatest(F.lit(1e-12), F.sqrt(dot(v, v)))
    met = met.select("meeting_id", "key", "old_key", "status", (dot("v", "w") / length("v") / length("w")).alias("likeness")).where(F.col("likeness") > least)

    many = sizes.where("NOT small").drop("small")
    asked = voices.join(many, by).selectExpr("*", "pmod(xxhash64(key, v), own) AS i", "explode(sequence(0L, held - 1L)) AS j").select(*by, "i", "j", "key", "v")
    known = decided.join(many, by).selectExpr("*", "pmod(xxhash64(old_key, w), held) AS j", "explode(sequence(0L, own - 1L)) AS i").select(*by, "i", "j", "old_key", "status", "w")
    known = known.toDF(*known.columns)  # new names to Spark, where both sides come from one table
    schema = to_arrow_schema(met.schema)

    def meet(own: pa.Table, held: pa.Table) -> pa.Table:
        if not len(own) or not len(held):
            return schema.empty_table()
        held = held.take(pc.sort_indices(held, sort_keys=[("old_key", "ascending")], null_placement="at_start"))
        row, col, alike = _most_alike(_columns(own["v"]), _columns(held["w"]), least)
        own, held = own.select(["meeting_id", "key"]).take(row), held.select(["old_key", "status"]).take(col)
        return pa.table([*own.columns, *held.columns, alike], names=schema.names).cast(schema)

    pairs = asked.groupBy(*by, "i", "j").cogroup(known.groupBy(*by, "i", "j"))
    met = met.unionByName(pairs.applyInArrow(meet, met.schema))
    best = met.groupBy("meeting_id", "key").agg(F.expr("min_by(struct(old_key, status, likeness), struct(-likeness, old_key))").alias("b"))
    return best.select("meeting_id", "key", "b.*")


def rename_speakers(people: DataFrame, changes: DataFrame) -> DataFrame:
    """L24. Changes (id, name) with whether they hold: not where another person has the name, case aside, and of
    the other changes to one name only that of the smallest id."""
    known = people.selectExpr("id AS other", "lower(name) AS l").groupBy("l").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    rows = changes.selectExpr("id", "trim(name) AS name", "lower(trim(name)) AS l").where("l <> ''")
    rows = rows.join(known, "l", "left").selectExpr("id", "name", "l", "coalesce(low = id AND high = id, true) AS free")
    return rows.selectExpr("id", "name", "free AND row_number() OVER (PARTITION BY l, free ORDER BY id) = 1 AS accepted")


def typical_samples(candidates: DataFrame, most: int = 5) -> DataFrame:
    """L13. Of the candidates (meeting_id, key, id, embedding) of each voice of a meeting the `most` that are most like their own
    centroid (the smaller id on ties)."""
    rows = candidates.where("embedding IS NOT NULL").select("meeting_id", "key", "id", unit("embedding").alias("v"))
    sums = rows.select("meeting_id", "key", F.posexplode("v").alias("dim", "x")).groupBy("meeting_id", "key", "dim").agg(F.sum("x").alias("x"))
    total = sums.groupBy("meeting_id", "key").agg(F.expr("transform(array_sort(collect_list(struct(dim, x))), v -> v.x)").alias("total"))
    centre = total.select("meeting_id", "key", unit("total").alias("centre"))
    rows = rows.join(centre, ["meeting_id", "key"]).select("meeting_id", "key", "id", F.round(dot("v", "centre"), 6).alias("likeness"))
    return rows.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id, key ORDER BY likeness DESC, id) AS place").where(f"place <= {most}").drop("place")


def spread_names(people: DataFrame, meeting_speakers: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L24. People (id, name, color, notes) and meeting_speakers (.., speaker_id, label, color) after changes (id, name, color, notes):
    a name that holds becomes the label in all meetings, a color #rrggbb theirs; notes are cut to 2000 characters. Null
    fields leave things as they are; of several changes to one person the greatest values count."""
    told = rename_speakers(people, changes).where("accepted").groupBy("id").agg(F.max("name").alias("_name"))
    other = changes.groupBy("id").agg(F.max(F.expr("if(color RLIKE '^#[0-9a-fA-F]{6}$', color, NULL)")).alias("_color"), F.max(F.expr("left(notes, 2000)")).alias("_notes"))
    new = other.join(told, "id", "left")
    done = people.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("name", "color", "notes")}).select(*people.columns)
    rows = meeting_speakers.join(new.withColumnRenamed("id", "speaker_id"), "speaker_id", "left")
    return done, rows.withColumns({"label": F.coalesce("_name", "label"), "color": F.coalesce("_color", "color")}).select(*meeting_speakers.columns)


def auto_learn(matches: DataFrame, auto: float, margin: float = 0.08) -> DataFrame:
    """L14. Automatic matches sure enough to learn from."""
    return matches.where((F.col("status") == "auto") & (F.col("confidence") >= round(auto + margin, 6)))


BLOCK_BYTES, PIECE_VISITS, PROBES_AT_ONCE = 64_000_000, 20_000, 256
MOST_BLOCKS, FEW_PEOPLE = 4096, 100
BY_CENTROID, BY_SAMPLES, BEST_SAMPLES = 0.6, 0.4, 3
MOST_SAMPLES = 40
SLACK = 1e-9  # of bounds, for rounding


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _best_mean(sims: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the mean of the three best of each run of columns; runs of one size are taken together."""
    out = np.empty((len(sims), len(first)))
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        runs = sims[:, (first[own][:, None] + np.arange(n)).ravel()].reshape(len(sims), len(own), n)
        out[:, own] = (np.partition(runs, n - BEST_SAMPLES, axis=2)[:, :, -BEST_SAMPLES:] if n > BEST_SAMPLES else runs).mean(axis=2)
    return out


def voice_blocks(samples: DataFrame, model: str = "cur", blocks: int | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, pd.DataFrame, np.ndarray]:
    """People by block: (a written table of speaker_id, block, v; of each block its pivot, people, and the widest angles from the pivot to
    their centroids and to their samples; the pivots). Pivots are centroids of people drawn by hash, twice the root of their number (MOST_BLOCKS at
    most; up to FEW_PEOPLE are one block, as nothing is won there); a person is in the block of the nearest pivot, blocks of over block_bytes
    are cut by hash."""
    own = samples.where((F.col("model") == model) & F.col("embedding").isNotNull()).select("speaker_id", unit("embedding").alias("v"))
    known = written(profiles(samples.where("embedding IS NOT NULL"), model).select("speaker_id", "n", "centroid"), "voice-profiles")
    people = known.count()
    wanted = blocks or (1 if people <= FEW_PEOPLE else min(MOST_BLOCKS, int(np.ceil(2 * np.sqrt(people)))))
    drawn = known.orderBy(F.xxhash64("speaker_id"), "speaker_id").limit(wanted).collect()  # MOST_BLOCKS at most
    pivots = np.array([r["centroid"] for r in drawn], dtype=np.float64).reshape(len(drawn), len(drawn[0]["centroid"]) if drawn else 0)
    kind = samples.schema["speaker_id"].dataType.simpleString()

    def nearest(parts):
        for part in parts:
            x = _unit_rows(np.vstack(part["centroid"].to_list()))
            cosines = x @ pivots.T
            block = cosines.argmax(axis=1)
            yield pd.DataFrame({"speaker_id": part["speaker_id"], "pivot": block, "n": part["n"], "wide": _angle(cosines[np.arange(len(x)), block])})

    def angles(parts):
        for part in parts:
            x = np.vstack(part["v"].to_list())
            yield part.assign(wide_s=_angle((x * pivots[part["pivot"].to_numpy()]).sum(axis=1)))

    placed = written(known.mapInPandas(nearest, f"speaker_id {kind}, pivot long, n long, wide double"), "voice-places")
    size = 16 + 8 * (pivots.shape[1] if len(drawn) else 0)
    parts = placed.groupBy("pivot").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * size / block_bytes)).cast("long").alias("parts"))
    placed = placed.join(F.broadcast(parts), "pivot").withColumn("block", F.expr(f"pivot + {max(1, len(drawn))}L * pmod(xxhash64(speaker_id), parts)"))
    met = own.join(placed.select("speaker_id", "pivot", "block", "wide"), "speaker_id")
    table = written(met.select("speaker_id", "pivot", "block", "wide", "v").mapInPandas(angles, f"speaker_id {kind}, pivot long, block long, wide double, v array<double>, wide_s double"), "voice-blocks")
    about = table.groupBy("block").agg(F.first("pivot").alias("pivot"), F.countDistinct("speaker_id").alias("people"), F.max("wide").alias("wide"), F.max("wide_s").alias("wide_s"))
    return table.select("speaker_id", "block", "v"), about.orderBy("block").toPandas(), pivots  # a row for each block


def _bounds(x: np.ndarray, about: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    """The greatest score that anybody in each block can have with each voice, by the triangle inequality of angles."""
    angle = _angle(x @ pivots.T)[:, about["pivot"].to_numpy()]
    least = lambda wide: np.cos(np.maximum(0.0, angle - about[wide].to_numpy()))
    return BY_CENTROID * least("wide") + BY_SAMPLES * least("wide_s") + SLACK


def _scored(visits: DataFrame, people: DataFrame, keep: int, schema: str, piece: int) -> DataFrame:
    """The best `keep` people of each block for the voices that visit it; a task is a block and a piece of its visits."""
    pieces = visits.groupBy("block").agg(F.expr(f"count(*) div {piece} + 1").alias("pieces"))
    asked = visits.join(pieces, "block").select("meeting_id", "key", "block", "embedding", F.expr("pmod(xxhash64(meeting_id, key), pieces)").alias("j"))
    shares = pieces.select(F.col("block").alias("of"), F.col("pieces").alias("shares"))
    known = people.join(shares, F.col("block") == F.col("of")).select("speaker_id", "v", F.col("of").alias("block"), F.explode(F.expr("sequence(0L, shares - 1L)")).alias("j"))

    def score(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if probes.empty or held.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("meeting_id", "key", "speaker_id", "score")})
        held = held.sort_values("speaker_id", ignore_index=True)
        ids, first, size = np.unique(held["speaker_id"].to_numpy(), return_index=True, return_counts=True)
        vectors = _unit_rows(np.vstack(held["v"].to_list()))
        centres = _unit_rows(np.add.reduceat(vectors, first, axis=0))
        whole, parts = _unit_rows(np.vstack(probes["embedding"].to_list())), []
        for at in range(0, len(whole), PROBES_AT_ONCE):
            x = whole[at : at + PROBES_AT_ONCE]
            made = BY_CENTROID * (x @ centres.T) + BY_SAMPLES * _best_mean(x @ vectors.T, first, size)
            order = np.lexsort((np.broadcast_to(np.arange(len(ids)), made.shape), -made), axis=1)[:, :keep]
            row = np.repeat(np.arange(len(x)), order.shape[1])
            parts.append((at + row, ids[order.ravel()], made[row, order.ravel()]))
        row, who, score = (np.concatenate(c) for c in zip(*parts))
        names = {c: pd.Series(probes[c].to_list(), dtype=object).iloc[row].reset_index(drop=True) for c in ("meeting_id", "key")}
        return pd.DataFrame({**names, "speaker_id": who, "score": score})

    return asked.groupBy("block", "j").cogroup(known.groupBy("block", "j")).applyInPandas(score, schema)


def match_scores(voiceprints: DataFrame, samples: DataFrame, model: str = "cur", keep: int | None = None, blocks: int | None = None, block_bytes: int = BLOCK_BYTES, piece: int = PIECE_VISITS, counted: list | None = None) -> DataFrame:
    """L8. Each voice (meeting_id, key, embedding) with the `keep` people it is most like: 0.6 of its cosine with a person's
    centroid and 0.4 of the mean of the three best with samples. Without `keep` that is one more than the voices of the largest
    meeting, and two at least, so that an assignment of people to voices and its margins lose nothing.

    A similarity join that skips what can't count: a voice first visits the blocks of people (voice_blocks) that promise most, as many as
    hold `keep` people; its score of place `keep` there is what any other has to beat. Then it visits the blocks whose bound is no
    lower, and no others. Exact: a bound is never below a score. counted: gets (pairs compared, all pairs)."""
    rows = voiceprints.where("embedding IS NOT NULL").selectExpr("meeting_id", "key", "cast(embedding AS array<double>) AS embedding")
    if keep is None:
        keep = 1 + (rows.groupBy("meeting_id").count().agg(F.max("count")).first()[0] or 1)
    people, about, pivots = voice_blocks(samples, model, blocks, block_bytes)
    person = samples.schema["speaker_id"].dataType.simpleString()
    voice = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:2])
    schema, visit = f"{voice}, speaker_id {person}, score double", f"{voice}, block long, embedding array<double>"
    if about.empty:
        return rows.sparkSession.createDataFrame([], schema)
    numbers, sizes = about["block"].to_numpy(), about["people"].to_numpy()

    def visits(first: bool):
        def run(parts):
            for part in parts:
                bounds = _bounds(_unit_rows(np.vstack(part["embedding"].to_list())), about, pivots)
                order = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                early = np.zeros(bounds.shape, dtype=bool)
                np.put_along_axis(early, order, before < keep, axis=1)
                go = early if first else ~early & (bounds >= part["least"].to_numpy(dtype=float)[:, None])
                row, block = np.nonzero(go)
                yield pd.DataFrame({"meeting_id": part["meeting_id"].to_numpy()[row], "key": part["key"].to_numpy()[row], "block": numbers[block], "embedding": part["embedding"].to_numpy()[row]})

        return run

    early = written(rows.mapInPandas(visits(True), visit), "voice-visits")
    found = written(_scored(early, people, keep, schema, piece), "voice-scores")
    if len(about) == 1:
        counted is not None and counted.extend([int(sizes.sum()) * rows.count()] * 2)
        return found
    # Fewer than `keep` people in all: nobody may be skipped.
    least = found.groupBy("meeting_id", "key").agg(F.expr(f"coalesce(get(sort_array(collect_list(score), false), {keep - 1}), -2D)").alias("least"))
    late = written(rows.join(least, ["meeting_id", "key"]).mapInPandas(visits(False), visit), "voice-visits")
    if counted is not None:
        inside = early.select("block").unionByName(late.select("block")).groupBy("block").count().collect()
        of = dict(zip(numbers.tolist(), sizes.tolist()))
        counted += [sum(of[r["block"]] * r["count"] for r in inside), int(sizes.sum()) * rows.count()]
    found = found.unionByName(_scored(late, people, keep, schema, piece))
    return found.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id, key ORDER BY score DESC, speaker_id) AS place").where(f"place <= {keep}").drop("place")


def recognise(scores: DataFrame, auto: float = 0.62, suggest: float = 0.48, margin: float = 0.05) -> DataFrame:
    """L9. Voices (meeting_id, key) with status, confidence, speaker_id and suggested_id: people are dealt one to one to the
    voices of a meeting for the greatest total score; `auto` from auto on if `margin` above the next person, `suggested` from
    suggest on, else unknown. A person alone in the library has margin 1. A meeting's voices are few and make one group."""
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    schema = f"meeting_id {kinds['meeting_id']}, key {kinds['key']}, status string, confidence double, speaker_id {kinds['speaker_id']}, suggested_id {kinds['speaker_id']}"

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot(index="key", columns="speaker_id", values="score").fillna(-9.0)
        rows = {k: (group["meeting_id"].iloc[0], k, "unknown", 0.0, None, None) for k in table.index}
        values = table.to_numpy()
        for i, j in best_assignment(values):
            score, others = values[i, j], np.delete(values[i], j)
            person, key = table.columns[j], table.index[i]
            if score <= -9:
                continue
            sure = score >= auto and (score - others.max() if len(others) else 1.0) >= margin
            status = "auto" if sure else "suggested" if score >= suggest else "unknown"
            rows[key] = (rows[key][0], key, status, round(float(score), 3), person if status == "auto" else None, person if status == "suggested" else None)
        return pd.DataFrame(list(rows.values()), columns=["meeting_id", "key", "status", "confidence", "speaker_id", "suggested_id"])

    return scores.groupBy("meeting_id").applyInPandas(deal, schema)


PRUNE_BLOCK = 4096


def _later_best(rows: np.ndarray, places: np.ndarray, others: np.ndarray, other_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosine, place) of what is most like each row among the others of a later place; -2 and the row's own place without any."""
    best, at = np.full(len(rows), -2.0), places.copy()
    for a in range(0, len(rows), PROBES_AT_ONCE):
        sims = rows[a : a + PROBES_AT_ONCE] @ others.T
        sims[other_places[None, :] <= places[a : a + PROBES_AT_ONCE, None]] = -2.0
        k = sims.argmax(axis=1) if len(others) else np.empty(0, int)
        top = sims[np.arange(len(sims)), k]
        best[a : a + PROBES_AT_ONCE] = top
        at[a : a + PROBES_AT_ONCE] = np.where(top > -2.0, other_places[k], places[a : a + PROBES_AT_ONCE])
    return best, at


def _thinned(x: np.ndarray, best: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Places that stay. The closest pair of what is left loses its earlier member, until `most` are left. A heap holds each place's
    best later partner; it is looked up anew only when the place comes up and the partner is gone."""
    n = len(x)
    stays = np.ones(n, dtype=bool)
    heap = [(-b, i) for i, b in enumerate(best.tolist()) if b > -2.0]
    heapq.heapify(heap)
    left, live, vectors = n, np.arange(n), x
    while left > most and heap:
        _, i = heapq.heappop(heap)
        if stays[at[i]]:
            stays[i] = False
            left -= 1
            if 2 * left < len(live):
                live = live[stays[live]]
                vectors = x[live]
            continue
        k = np.searchsorted(live, i, "right")
        later = live[k:]
        sims = np.where(stays[later], vectors[k:] @ x[i], -2.0)
        if len(sims) and (top := int(sims.argmax())) >= 0 and sims[top] > -2.0:
            at[i] = later[top]
            heapq.heappush(heap, (-float(sims[top]), i))
    return np.flatnonzero(stays)


def prune(samples: DataFrame, most: int = MOST_SAMPLES, model: str = "cur", block: int = PRUNE_BLOCK) -> DataFrame:
    """L6. The ids of each person's samples of the current model that stay: while there are over `most`, the one most like another
    goes (the first by id on ties). Samples of other models stay and don't count.

    That rule takes the closest pairs one after another and drops the earlier member of each, so all it needs is the best later partner
    of each sample. These are found in blocks of samples, a task for each pair of blocks of a person, without a matrix of a whole
    person; what is left to one task is a person's vectors and a heap. People within the limit never enter a group."""
    now = samples.where((F.col("model") == model) & F.col("embedding").isNotNull())
    count = now.groupBy("speaker_id").agg(F.count("*").alias("n"))
    rows = now.select("speaker_id", "id", unit("embedding").alias("v")).join(count.where(f"n > {most}"), "speaker_id")
    rows = written(rows.selectExpr("speaker_id", "id", "v", f"n div {block} + 1 AS blocks", f"pmod(xxhash64(id), n div {block} + 1) AS own"), "prune-samples")
    dealt = rows.withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1L)"))).withColumns({"a": F.least("own", "o"), "b": F.greatest("own", "o")})
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def partners(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        x, places = np.vstack(group["v"].to_list()), np.arange(len(group))
        sides = [np.flatnonzero((group["own"] == group[c]).to_numpy()) for c in ("a", "b")]
        met = [(sides[0], sides[1])] + ([(sides[1], sides[0])] if (group["a"] != group["b"]).any() else [])
        out = []
        for own, other in met:
            best, at = _later_best(x[own], places[own], x[other], places[other])
            out.append(pd.DataFrame({"speaker_id": group["speaker_id"].iloc[own], "id": group["id"].iloc[own], "best": best, "partner": group["id"].to_numpy()[at]}))
        return pd.concat(out)

    found = dealt.groupBy("speaker_id", "a", "b").applyInPandas(partners, f"speaker_id {kinds['speaker_id']}, id {kinds['id']}, best double, partner {kinds['id']}")
    found = found.groupBy("speaker_id", "id").agg(F.expr("max_by(struct(best, partner), best)").alias("p")).select("speaker_id", "id", "p.*")

    def lean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        at = np.searchsorted(group["id"].to_numpy(), group["partner"].to_numpy())
        stay = _thinned(np.vstack(group["v"].to_list()), group["best"].to_numpy(), at, most)
        return group.loc[stay, ["speaker_id", "id"]]

    cut = rows.select("speaker_id", "id", "v").join(found, ["speaker_id", "id"]).groupBy("speaker_id").applyInPandas(lean, f"speaker_id {kinds['speaker_id']}, id {kinds['id']}")
    within = samples.join(count.where(f"n > {most}").select("speaker_id"), "speaker_id", "left_anti").select("speaker_id", "id")
    others = samples.where((F.col("model") != model) | F.col("model").isNull() | F.col("embedding").isNull()).join(count.where(f"n > {most}").select("speaker_id"), "speaker_id", "left_semi").select("speaker_id", "id")
    return within.unionByName(others).unionByName(cut)
