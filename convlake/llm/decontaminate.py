"""Benchmark decontamination with suffix arrays over the training text.

Documents come in shards of about SHARD_CHARS characters. A shard's words are numbered by the
benchmark's vocabulary (0: a word that no item has, or the end of a document), and its suffix array
holds every position of a benchmark word, sorted by the words that follow up to the next 0; prefix
doubling goes on until as many words are compared as the longest item has.

Every suffix of a benchmark item that begins a window is binary-searched in the array, word by word,
all of them at once. The range left after the window's words is every place where it stands. Places
whose words before are alike are those of the suffix before; of the others each is extended word by
word to the longest verbatim match, with its location in document and item. A document word lies in
an occurrence of a window if and only if it lies in such a match.

A window is WINDOW consecutive words of an item; a shorter item, if it has words, is one window.
The benchmark is broadcast in blocks of BLOCK_CHARS characters (about 60 MB as built), searched one
after another; what a block's suffixes are met by is extended in bounded portions.

Edge cases: a null or empty text has no words and no hit; null or empty items, and items with null
id, are ignored; an empty benchmark hits nothing; items of equal text all count; repeated documents
are reported one by one; items_sha256 of no items is that of the empty string; extra columns pass
through, but for those with names of results.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_CHARS = 4_000_000
SHARD_CHARS = 16_000_000
PORTION = 1 << 21


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased: runs of 0-9, a-z and what is beyond ASCII."""
    return WORD.findall(text.encode(errors="surrogatepass").lower()) if text else []


class Block:
    """Some items as one sequence of word numbers, a 0 after each, and the suffixes that begin a window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_words: dict[tuple[int, ...], list[str]] = {}
        for item, text in sorted(items):
            words = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            if words:
                by_words.setdefault(words, []).append(item)
        self.names = [sorted(set(n)) for n in by_words.values()]  # items of equal words go together
        size = np.array([len(w) for w in by_words], dtype=np.int64)
        self.starts = np.cumsum(size + 1) - size - 1
        self.ids = np.zeros(int((size + 1).sum()) + 1, dtype=np.int32)
        for words, a in zip(by_words, self.starts):
            self.ids[a : a + len(words)] = words
        many = np.maximum(size - window, 0) + 1
        self.owner = np.repeat(np.arange(len(size)), many)
        self.suffixes = self.starts[self.owner] + np.arange(len(self.owner)) - np.repeat(np.cumsum(many) - many, many)
        self.need = np.minimum(size, window)[self.owner]
        self.least, self.longest = (int(self.need.min()), int(size.max())) if len(size) else (0, 0)


def suffix_array(ids: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """The positions with `least` words or more before the next 0, sorted by these words, the first `depth` at least."""
    stops = np.flatnonzero(ids == 0)
    run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
    at = np.flatnonzero(run > 0)
    rank = np.zeros(len(ids), dtype=np.int64)
    rank[at] = ids[at]
    done = 1
    while done < depth and len(at):
        after = np.where(run[at] > done, rank[np.minimum(at + done, len(ids) - 1)], 0)
        key = rank[at] * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[at[order]] = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        done *= 2
    array = at[np.argsort(rank[at], kind="stable")]
    return array[run[array] >= least]


def _bound(ids: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, word: np.ndarray, right: bool) -> np.ndarray:
    """Per range of the array, whose suffixes agree on k words, the first place where the next word is not below `word`
    (or with `right` above it)."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        here = ids[array[middle] + k]
        below = here <= word[live] if right else here < word[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    return low


def ranges(block: Block, ids: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix of the block the range of the array that begins with its window; empty where low = high."""
    low, high = np.zeros(len(block.suffixes), dtype=np.int64), np.full(len(block.suffixes), len(array))
    for k in range(int(block.need.max()) if len(block.need) else 0):
        live = np.flatnonzero((block.need > k) & (low < high))
        if not len(live):
            break
        word = block.ids[block.suffixes[live] + k]
        a, b = low[live], high[live]
        low[live] = _bound(ids, array, a, b, k, word, False)
        high[live] = _bound(ids, array, low[live], b, k, word, True)
    return low, high


def matches(block: Block, ids: np.ndarray):
    """Portions of the longest verbatim matches: (position in ids, position in block.ids, words, owner). ids end with a 0."""
    if not len(ids) or not len(block.suffixes):
        return
    array = suffix_array(ids, block.longest, block.least)
    low, high = ranges(block, ids, array)
    met = np.flatnonzero(high > low)
    total = np.cumsum(high[met] - low[met])
    cuts = np.searchsorted(total, np.arange(PORTION, total[-1] if len(total) else 0, PORTION), "right")
    for part in np.split(met, np.unique(cuts)):
        count = high[part] - low[part]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        p, s = array[np.repeat(low[part], count) + inside], np.repeat(part, count)
        t = block.suffixes[s]
        # What agrees on the word before too is part of the match that began there.
        before = np.where(t > 0, block.ids[t - 1], 0)
        new = (before == 0) | (p == 0) | (ids[p - 1] != before)
        p, s, t = p[new], s[new], t[new]
        size = block.need[s].copy()
        live = np.arange(len(p))
        while len(live):
            word = ids[p[live] + size[live]]
            live = live[(word != 0) & (word == block.ids[t[live] + size[live]])]
            size[live] += 1
        if len(p):
            yield p, t, size, block.owner[s]


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> list:
    """The benchmark as broadcast blocks of about block_chars characters, one on the driver at a time."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    part = F.pmod(F.xxhash64("item"), F.lit(n or 1))
    return [sc.broadcast(Block([tuple(r) for r in items.where(part == k).collect()], window)) for k in range(n)]


def _shards(batches, text: str):
    """Batches cut to about SHARD_CHARS bytes of text, each with the words of its rows."""
    for batch in batches:
        sizes = np.array([len(x) if x is not None else 0 for x in batch.column(text).to_pylist()])
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // SHARD_CHARS)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            part = batch.slice(a, b - a)
            yield part, [words_of(t) for t in part.column(text).to_pylist()]


def _numbered(block: Block, docs: list[list[bytes]], starts: np.ndarray) -> np.ndarray:
    """The words of all documents as ids; a 0 ends each document, and one more the shard."""
    ids = np.zeros(starts[-1] + 1, dtype=np.int64)
    get = block.vocabulary.get
    for words, a in zip(docs, starts):
        ids[a : a + len(words)] = np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words))
    return ids


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and longest (words of the longest match)."""
    sent = blocks_of(benchmark, window)
    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("longest", T.LongType())]
    keep = [c for c in docs.columns if c not in dict(added)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])

    def run(batches):
        for batch, words in _shards(batches, text):
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            starts = np.r_[0, np.cumsum(sizes + 1)]
            step = np.zeros(starts[-1] + 1, dtype=np.int64)
            longest = np.zeros(len(words), dtype=np.int64)
            items: dict[int, set[str]] = {}
            for one in sent:
                block = one.value
                for p, _, size, owner in matches(block, _numbered(block, words, starts)):
                    np.add.at(step, p, 1)
                    np.add.at(step, p + size, -1)
                    doc = np.searchsorted(starts, p, "right") - 1
                    np.maximum.at(longest, doc, size)
                    for d, i in np.unique(np.stack([doc, owner], axis=1), axis=0).tolist():
                        items.setdefault(d, set()).update(block.names[i])
            hit = np.r_[0, np.cumsum(np.cumsum(step[:-1]) > 0)]
            n_hit = hit[starts[1:]] - hit[starts[:-1]]
            joined = [",".join(sorted(items.get(d, ()))) for d in range(len(words))]
            made = [
                pa.array(sizes, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(items.get(d, ())) for d in range(len(words))], pa.int64()),
                pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                pa.array(n_hit > 0, pa.bool_()),
                pa.array(longest, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The longest verbatim matches: key, item_id, doc_start, item_start, n_words (words from 0).

    A match is as long as it can be on both sides, and has at least a window's words.
    """
    sent = blocks_of(benchmark, window)
    names = ["item_id", "doc_start", "item_start", "n_words"]
    schema = T.StructType([docs.schema[key]] + [T.StructField(n, T.LongType() if k else T.StringType()) for k, n in enumerate(names)])

    def run(batches):
        for batch, words in _shards(batches, text):
            starts = np.r_[0, np.cumsum(np.array([len(w) for w in words], dtype=np.int64) + 1)]
            keys = batch.column(key)
            for one in sent:
                block = one.value
                for p, t, size, owner in matches(block, _numbered(block, words, starts)):
                    doc = np.searchsorted(starts, p, "right") - 1
                    many = np.array([len(n) for n in block.names], dtype=np.int64)[owner]
                    row = np.repeat(np.arange(len(p)), many)
                    item = [name for i in owner.tolist() for name in block.names[i]]
                    made = [pa.array(item, pa.string())] + [pa.array(c[row], pa.int64()) for c in (p - starts[doc], t - block.starts[owner], size)]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[row])), *made], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("_doc"), F.col("text").alias("text"))
    return contamination(packed, benchmark, window).where("NOT contaminated").select(*[F.col("_doc")[n].alias(n) for n in names])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH b AS (SELECT item_id::varchar AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[a : a + {WINDOW} - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS a FROM b WHERE len(ws) > 0)
), d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (
  SELECT doc_id, n, a, array_to_string(ws[a : a + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), m AS (SELECT dw.doc_id, dw.a, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS k FROM (SELECT DISTINCT doc_id, a, n FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "binary") AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
