"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64 bits: bit i is 1 if it is set in over half of the XXH64 hashes of a text's word
shingles. Two fingerprints that differ in at most RADIUS bits are linked; a component is what links
reach.

A vantage-point tree splits the distinct fingerprints into shards by their Hamming distance to
vantage points: at a node what is no further than its middle goes inside, the rest outside. Vantage
points and middles come from a sample of at most about 2 x MOST_SAMPLE fingerprints; every
fingerprint is then routed. It has one home shard, and visits each shard across a boundary that its
ball of RADIUS overlaps; by the triangle inequality nothing linked to it is elsewhere. Of the two
sides of a boundary only the outer one visits the inner, so a pair meets once. In a shard the tree
goes on in memory, with the same bounds, down to LEAF fingerprints that are compared directly. A
shard over LARGE rows (so many fingerprints in one ball that no vantage point parts them) is cut
into pieces, and each pair of pieces is one unit of work. Exact; no caps.

Distances of unlike fingerprints crowd around 32 with a deviation of 4, so a level of the tree leaves
about three quarters of the pairs: n fingerprints cost about n to the power 1.6 comparisons, and a
fingerprint visits about half of 1.55 to the power of the tree's depth shards.

`deduplicate_similar` links by similarity instead: fingerprints of 256 bits, in shards of texts that
share a band of least hashes.

A shard's links leave it as a star per component, never as all pairs. Equal fingerprints are one
node from the start, so copies cost nothing.

Edge cases: a null or empty text has no shingles, fingerprint zero, and is linked as any other; rows
that repeat a doc_id each get a row; null doc_ids never name a component unless it has no other;
`deduplicate` decides by row and keeps exactly one of each component; an empty table gives no rows; extra columns pass
through `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import discard, materialise

SHINGLE = 3
RADIUS = 3
SHARD = 1 << 15
LARGE = 1 << 18
LEAF = 512
SAMPLE_PER_SHARD = 64
LEAST_SAMPLE, MOST_SAMPLE = 1 << 13, 1 << 20
CANDIDATES = 8
PART = 1 << 16
WORDS, BANDS, ROWS = 4, 6, 2


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text; of the whole where it has fewer words; none without words."""
    import xxhash

    words = text.encode(errors="surrogatepass").lower().split() if text else []
    whole, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(whole, 42)] if words else [], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    return np.array([hashed(whole[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)


def _majority(parts, n: int) -> bytes:
    """The bits, first ones first, that are set in over half of n hashes, which come in parts."""
    ones = np.zeros(64, dtype=np.int64)
    for part in parts:
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def _parts(hashes: np.ndarray):
    return (hashes[a : a + PART] for a in range(0, len(hashes), PART))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned."""
    hashes = _hashes(text, shingle)
    return int.from_bytes(_majority(_parts(hashes), len(hashes)), "big")


def _odd(kind: str, n: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"{kind}{k}") | 1 for k in range(n)], dtype=np.uint64)


def _mixed(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
    made = hashes * factor
    made ^= made >> np.uint64(29)
    made *= factor
    return made ^ made >> np.uint64(32)


def sketch(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """The SimHash of one text in WORDS x 64 bits, the first 64 as in `fingerprint`, and a key for each of BANDS bands:
    what its ROWS least hashes, each under an order of its own, come to. A text without words has keys zero."""
    hashes = _hashes(text, shingle)
    n = len(hashes)
    bits = [_majority(_parts(hashes), n)]
    bits += [_majority((_mixed(part, f) for part in _parts(hashes)), n) for f in _odd("bits", WORDS - 1)]
    if not n:
        return b"".join(bits), np.zeros(BANDS, dtype=np.int64)
    least = np.array([min((part * f).min() for part in _parts(hashes)) for f in _odd("order", BANDS * ROWS)], dtype=np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        keys = _mixed(keys + row, np.uint64(0x9E3779B97F4A7C15))
    return b"".join(bits), keys.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint of each whole text, as a signed 64-bit integer, in place of the text."""
    keep = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made)], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


class Components:
    """Union-find over the indices of an array, many links at a time; counts the pairs compared and the branches pruned."""

    def __init__(self, n: int, distance=None):
        self.root = np.arange(n)
        self.distance = distance or _distance
        self.compared = self.pruned = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = self.root[self.root]
                if np.array_equal(jumped, self.root):
                    break
                self.root = jumped

    def one(self, *parts: np.ndarray) -> bool:
        """Whether all of them are linked already."""
        first = self.root[parts[0][0]]
        return all((self.root[p] == first).all() for p in parts)


def _distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _wide_distance(x: np.ndarray, y) -> np.ndarray:
    """The same of fingerprints of several words, which are the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _all_pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray, found: Components, radius: int) -> None:
    for k in range(0, len(a), LEAF):
        part = a[k : k + LEAF]
        for m in range(0, len(b), LEAF):
            other = b[m : m + LEAF]
            if not found.one(part, other):
                found.compared += len(part) * len(other)
                i, j = np.nonzero(found.distance(x[part][:, None], x[other][None, :]) <= radius)
                found.link(part[i], other[j])


def _across(x: np.ndarray, a: np.ndarray, b: np.ndarray, found: Components, radius: int) -> None:
    """Link what is within the radius between two sets of indices: b visits the sides of a that its balls overlap."""
    if not len(a) or not len(b) or found.one(a, b):
        return
    if len(a) * len(b) <= LEAF * LEAF:
        return _all_pairs(x, a, b, found, radius)
    vantage = x[(a if len(a) > len(b) else b)[0]]
    da, db = found.distance(x[a], vantage).astype(np.int16), found.distance(x[b], vantage).astype(np.int16)
    middle = int(np.median(np.r_[da, db]))
    near, far = b[db <= middle + radius], b[db > middle - radius]
    inner, outer = a[da <= middle], a[da > middle]
    if len(inner) * len(near) + len(outer) * len(far) > 0.95 * len(a) * len(b):
        return _all_pairs(x, a, b, found, radius)
    found.pruned += 2 * len(b) - len(near) - len(far)
    _across(x, inner, near, found, radius)
    _across(x, outer, far, found, radius)


def _within(x: np.ndarray, index: np.ndarray, found: Components, radius: int) -> None:
    """Link what is within the radius inside a set: split it by distance to a vantage point."""
    while len(index) > LEAF and not found.one(index):
        vantage, index = index[0], index[1:]
        d = found.distance(x[index], x[vantage]).astype(np.int16)
        near = index[d <= radius]
        found.link(near, np.full(len(near), vantage))
        middle = int(np.median(d))
        inner, outer = index[d <= middle], index[d > middle]
        if not len(outer):
            middle -= 1
            inner, outer = index[d <= middle], index[d > middle]
        if not len(inner):
            continue
        visit = index[(d > middle) & (d <= middle + radius)]
        found.pruned += len(outer) - len(visit)
        _across(x, index[(d <= middle) & (d > middle - radius)], visit, found, radius)
        small, index = (inner, outer) if len(inner) < len(outer) else (outer, inner)
        _within(x, small, found, radius)
    if len(index) > 1 and not found.one(index):
        _all_pairs(x, index, index, found, radius)


def search(homes: np.ndarray, visitors: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, Components]:
    """(fingerprint, root) stars of what is linked among the homes of a shard, or to one of them, and the state of the search."""
    x = np.concatenate([homes, visitors])
    found = Components(len(x), _wide_distance if x.ndim > 1 else None)
    own, other = np.arange(len(homes)), np.arange(len(homes), len(x))
    _within(x, own, found, radius)
    _across(x, own, other, found, radius)
    linked = np.flatnonzero(found.root != np.arange(len(x)))
    return x[linked], x[found.root[linked]], found


class Tree:
    """Vantage points, each with the middle that splits what is around it; the leaves are shards.

    Fitted on a sample, for about so many shards as are wanted. Of CANDIDATES vantage points that has the
    node whose boundary the fewest balls overlap.
    """

    def __init__(self, sample: np.ndarray, shards: int, radius: int = RADIUS):
        self.radius, self.shards = radius, 0
        self.nodes: list[tuple] = []  # (vantage, middle, inner, outer), or (None, shard)
        self._grow(np.asarray(sample, dtype=np.uint64), shards)

    def _split(self, x: np.ndarray) -> tuple | None:
        best = None
        for vantage in x[:: -(-len(x) // CANDIDATES)]:
            d = _distance(x, vantage).astype(np.int16)
            middle = int(np.median(d))
            middle -= not (d > middle).any()
            overlap = int(((d > middle - self.radius) & (d <= middle + self.radius)).sum())
            if (d <= middle).any() and (best is None or overlap < best[0]):
                best = overlap, vantage, middle, d <= middle
        return best

    def _grow(self, x: np.ndarray, shards: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = self._split(x) if shards > 1 and len(x) > 1 else None
        if split is None:
            self.nodes[at] = None, self.shards
            self.shards += 1
        else:
            _, vantage, middle, inside = split
            share = round(shards * inside.mean())
            self.nodes[at] = vantage, middle, self._grow(x[inside], share), self._grow(x[~inside], shards - share)
        return at

    def route(self, x: np.ndarray):
        """(shard, indices of x, whether it is their home) of every shard that x belongs to or visits."""
        todo = [(0, np.arange(len(x)), np.ones(len(x), dtype=bool))]
        while todo:
            at, index, home = todo.pop()
            if not len(index):
                continue
            vantage, *rest = self.nodes[at]
            if vantage is None:
                yield rest[0], index, home
                continue
            middle, inner, outer = rest
            d = _distance(x[index], vantage).astype(np.int16)
            inside, outside = d <= middle + self.radius, np.where(home, d > middle, d > middle - self.radius)
            todo += [(inner, index[inside], home[inside] & (d[inside] <= middle)), (outer, index[outside], home[outside])]


def tree_of(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> Tree:
    """The tree over the distinct fingerprints of nodes (column fp), about `shard` of them in each leaf."""
    n = nodes.count()
    shards = -(-n // shard)
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLE_PER_SHARD * shards))
    sample = nodes.where(F.expr(f"pmod(xxhash64(fp), {max(1, n // size)}) = 0")).select("fp").collect() if shards > 1 else []
    return Tree(np.sort(np.array([r[0] for r in sample], dtype=np.int64)).view(np.uint64), shards, radius)


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD, large: int = LARGE) -> DataFrame:
    """Stars (u, v) that connect the distinct fingerprints of nodes (column fp) as all links would."""
    sent = nodes.sparkSession.sparkContext.broadcast(tree_of(nodes, radius, shard))

    def route(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for number, index, home in sent.value.route(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), number, dtype=np.int32)), pa.array(x[index].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    routed = nodes.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return _linked(routed, radius, large)


def _linked(routed: DataFrame, radius: int, large: int = LARGE) -> DataFrame:
    """Stars (u, v) of the fingerprints of each shard; routed (shard, fp, home), where fp is a long, or binary if wider."""
    kind = routed.schema["fp"].dataType.simpleString()
    sizes = routed.groupBy("shard").agg(F.expr(f"cast(ceil(count(*) / {large}) AS int)").alias("pieces")).where("pieces > 1")  # a row per large shard
    rows = routed.join(F.broadcast(sizes), "shard", "left").withColumn("p", F.expr("cast(pmod(xxhash64(fp), coalesce(pieces, 1)) AS int)"))
    rows = rows.withColumn("q", F.explode(F.expr("sequence(0, coalesce(pieces, 1) - 1)")))
    keys = ["shard", "i", "j"]

    def loaded(column) -> np.ndarray:
        if kind == "bigint":
            return column.to_numpy().view(np.uint64)
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), WORDS)

    def stored(x: np.ndarray) -> pa.Array:
        return pa.array(x.view(np.int64)) if x.ndim == 1 else pa.array([row.tobytes() for row in x], pa.binary())

    rows = rows.selectExpr("shard", "least(p, q) AS i", "greatest(p, q) AS j", "fp", "home").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[tuple] = []
        at = None

        def close():
            if sum(len(fp) for fp, _ in held) < 2:
                held.clear()
            else:
                fp, home = (np.concatenate(c) for c in zip(*held))
                held.clear()
                u, v, _ = search(fp[home], fp[~home], radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([stored(u), stored(v)], ["u", "v"])

        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            fp, home = loaded(batch.column("fp")), batch.column("home").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fp)]):
                if a == b:
                    continue
                if at != (own := tuple(where[a].tolist())):
                    yield from close()
                    at = own
                held.append((fp[a:b], home[a:b]))
        yield from close()

    return rows.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) of every node that has an edge (u, v): large stars and small stars in turn.

    Minima are aggregated before they are shuffled and joined back, so a hub's neighbours never meet in a list.
    """
    now = materialise(edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u <> v").distinct(), "components")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v"))
        last, now = now, materialise(small.distinct(), "components")
        discard(last)
        state = tuple(now.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(u, v) AS decimal(38, 0))), 0)")).first())
        if state == before:
            return now.selectExpr("u AS node", "v AS root")
        before = state
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, root and least of nodes (fp, least): root is one for all of a component."""
    nodes = materialise(nodes, "simhash-nodes")
    return _named(nodes, links(nodes.select("fp"), radius))


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").selectExpr("fp", "coalesce(root, fp) AS root", "least")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the component) of every document."""
    fps = materialise(fingerprints(docs.select("doc_id", "text"), shingle=shingle), "simhash")
    named = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), radius)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _first():
    """What comes first of a group: the smallest doc_id, nulls last, then by a hash of the text, then by row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th", "_row")).alias("least")


def _kept(rows: DataFrame, fps: DataFrame, named: DataFrame) -> DataFrame:
    """The rows that come first in their component."""
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select("least._row")
    gone = fps.select("_row").join(kept, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti")


def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id, nulls last, then by a hash of the text.

    Rows are numbered once and written, so that rows which are equal in everything are told apart.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    fps = materialise(fingerprints(rows.select("doc_id", F.xxhash64("text").alias("_th"), "_row", "text"), out="fp", shingle=shingle), "simhash")
    named = _rooted(fps.groupBy("fp").agg(_first()), radius)
    return _kept(rows, fps, named).select(*docs.columns)


def radius_of(similarity: float) -> int:
    """The bits of a wide fingerprint in which texts of this Jaccard similarity are expected to differ."""
    return round(64 * WORDS * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi))


def sketches(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """docs with `fp`, the wide fingerprint of each whole text, and the keys k0, k1, ... of its bands in place of the text."""
    keep = [c for c in docs.columns if c != text]
    names = [f"k{k}" for k in range(BANDS)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.BinaryType())] + [T.StructField(k, T.LongType()) for k in names])

    def run(batches):
        for batch in batches:
            if len(batch):
                bits, keys = zip(*(sketch(t.as_py(), shingle) for t in batch.column(text)))
                made = [pa.array(bits, pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in np.stack(keys).T)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def similar_links(nodes: DataFrame, radius: int, large: int = LARGE) -> DataFrame:
    """Stars (u, v) of the wide fingerprints of nodes (fp, keys) that share a key and lie within the radius."""
    return _linked(nodes.select(F.explode("keys").alias("shard"), "fp", F.lit(True).alias("home")), radius, large)


def deduplicate_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of docs for each group of texts whose shingles are similar, chosen as by `deduplicate`.

    Texts of Jaccard similarity 0.8 differ in about 39 of 256 bits, unlike ones in 128 with a deviation of 8: a ball of that
    radius overlaps both sides of every boundary, so a tree over all fingerprints would prune nothing. Here the shards are
    bands of least hashes, in which unlike texts do not meet, and the trees stand inside them. Of pairs at 0.8 a share of
    0.998 have a band in common and half are within the radius; at 0.7 about one in twenty are, from 0.87 on nearly all.

    A null or empty text has keys zero and is a copy of any other such text; ids and ties as in `deduplicate`.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    made = materialise(sketches(rows.select("doc_id", F.xxhash64("text").alias("_th"), "_row", "text"), shingle), "simhash-sketches")
    keys = F.array(*[F.max(f"k{k}") for k in range(BANDS)]).alias("keys")
    nodes = materialise(made.groupBy("fp").agg(_first(), keys), "simhash-nodes")
    named = _named(nodes.select("fp", "least"), similar_links(nodes.select("fp", "keys"), radius_of(similarity)))
    return _kept(rows, made, named).select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id")
