"""Token-id output: Simple-8b word-aligned coding in block files.

A file is Parquet; a row of it is a chunk of whole documents. A chunk's ids are one sequence, cut
into blocks of BLOCK ids; a block is coded on its own as 64-bit words, and `block_words` holds where
each block's words begin, so that a reader decodes any block, or all at once, with array operations.

A word is a 4-bit selector above 60 bits of payload. Selector s from 1 to 14 packs SLOTS[s] ids of
BITS[s] bits each, the first in the lowest bits; selector 15 repeats the payload's low 40 bits as
often as its upper 20 bits say; selector 0 is an escape: its payload is the index of one id, over 60 bits wide, in
the chunk's `escapes`. The last word of a block may have unused slots, which are zero.

Ids are non-negative and fit 63 bits. Files are written through Spark's committer, so a task that
runs again leaves nothing twice.

Edge cases: a null text counts as empty and has the end id alone; repeated rows and ties in doc_id
are all written (order: doc_id, then a hash of the text; null doc_id first); a document longer than
a chunk is a chunk of its own; an empty table gives an empty file; extra columns aren't written.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
BLOCK = 256
CHUNK_IDS = 1 << 20
SHARD_BYTES = 16_000_000
CACHE_UNITS = 800_000
GROUP_BYTES = 8_000_000
CUT = "\x1f"  # texts that have it aren't cut

# Fixed values of the format: ids in a word, and bits of each, by selector.
SLOTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], dtype=np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 40], dtype=np.int64)
REPEAT, LEAST_REPEAT = 15, 61


def _shifts(sel: np.ndarray, first: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """By how many bits each of n ids is moved within its word; words begin at `first` and have `count` ids."""
    kind = np.int32 if n < 1 << 31 else np.int64
    bits = np.where(sel == REPEAT, 0, BITS[sel]).astype(kind)
    return ((np.arange(n, dtype=kind) - np.repeat(first.astype(kind), count)) * np.repeat(bits, count)).astype(np.uint64)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of non-negative ids; all blocks step together."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n, wide = len(ids), block + 64
    blocks = -(-n // block)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    # A row per block, with zeros behind it: what lies beyond a block's end always fits.
    padded = np.zeros(blocks * block, dtype=np.uint64)
    padded[:n] = ids
    rows = np.zeros((blocks, wide), dtype=np.uint64)
    rows[:, :block] = padded.reshape(blocks, block)
    flat, places = rows.ravel(), blocks * wide
    widths = np.zeros(places + 64, dtype=np.uint8)
    widths[:places] = np.maximum((flat.astype(np.float64).view(np.int64) >> 52) - 1022, 0)  # the exponent; nought has none
    most = {1: widths}  # the widest of so many ids from each position
    for size in (2, 4, 8, 16, 32):
        half = most[size // 2]
        most[size] = np.maximum(half[: -size // 2], half[size // 2 :])
    # What fits a selector fits the next, which has fewer ids and more bits.
    choice = np.full(places, 15, dtype=np.uint8)
    for s in range(1, 15):
        size = 1 << (int(SLOTS[s]).bit_length() - 1)
        back = int(SLOTS[s]) - size
        choice -= np.maximum(most[size][:places], most[size][back : back + places]) <= np.uint8(BITS[s])
    choice[choice == 15] = 0
    span = SLOTS.astype(np.int32)[choice]
    stops = np.full((blocks, wide), True)
    np.not_equal(rows[:, 1:block], rows[:, : block - 1], out=stops[:, : block - 1])
    ends = np.flatnonzero(stops)
    length = np.diff(ends, prepend=-1)
    long = np.flatnonzero((length >= LEAST_REPEAT) & (flat[ends] < np.uint64(1 << 40)))
    if len(long):
        inside = length[long] - LEAST_REPEAT + 1  # places of a run from which enough of it follows
        runs = np.arange(inside.sum()) + np.repeat(ends[long] + 1 - length[long] - np.cumsum(inside) + inside, inside)
        choice[runs], span[runs] = REPEAT, np.repeat(ends[long] + 1, inside) - runs
    at = np.arange(blocks) * wide
    stop = at + block
    stop[-1] = at[-1] + n - (blocks - 1) * block
    taken = np.zeros(places, dtype=np.int32)  # ids of the word that begins at a position
    while len(at):
        step = np.minimum(span[at], stop - at)
        taken[at] = step
        at = at + step
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
    starts = np.flatnonzero(taken)
    sel, count = choice[starts], taken[starts]
    first = np.cumsum(count) - count
    words = np.bitwise_or.reduceat(ids << _shifts(sel, first, count, n), first)
    runs, escaped = sel == REPEAT, sel == 0
    words[runs] = flat[starts[runs]] | (count[runs].astype(np.uint64) << np.uint64(40))
    words[escaped] = np.arange(escaped.sum(), dtype=np.uint64)
    words |= sel.astype(np.uint64) << np.uint64(60)
    return words, np.searchsorted(starts, np.arange(blocks) * wide), flat[starts[escaped]]


def unpack(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids again."""
    if not n:
        return np.empty(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    count = np.where(sel == REPEAT, (payload >> np.uint64(40)).astype(np.int64), SLOTS[sel])
    # The last word of a block has only what is left of the block.
    owner = np.searchsorted(block_words, np.arange(len(words)), "right") - 1
    before = np.cumsum(count) - count
    before -= before[block_words][owner]
    count = np.minimum(count, np.minimum((owner + 1) * block, n) - owner * block - before)
    first = np.cumsum(count) - count
    ids = (np.repeat(payload, count) >> _shifts(sel, first, count, n)) & np.repeat((np.uint64(1) << BITS[sel].astype(np.uint64)) - np.uint64(1), count)
    escaped = sel == 0
    ids[first[escaped]] = escapes[payload[escaped].astype(np.int64)]
    return ids


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + counts[k]] for all k, one after another."""
    total = int(counts.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts - np.cumsum(counts) + counts).astype(kind), counts) + np.arange(total, dtype=kind)]


class Encoder:
    """A byte-level BPE of the tokenizers library over whole texts.

    The pre-tokenizer of such a vocabulary always ends a piece before white space that follows
    something else, and behind letters that another ASCII sign follows. So a text's ids are those of
    its units, cut at such places by Arrow; distinct units come to Python and are remembered. Texts with
    a special token of the vocabulary, or with control letters on which notions of white space differ,
    are encoded at once.
    """

    piece = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # takes one piece, byte-level letters for bytes
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.letters = np.arange(256, dtype="<u2")
        self.letters[hidden] = 256 + np.arange(len(hidden))
        self.letters[10] = 10  # between pieces
        self.odd = "|".join([r"[\x1c-\x1f]", *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        space = r"\pZ\x09-\x0d\x{85}"
        self.cuts = [
            (r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-@\[-`{-~])", rf"\1{CUT}\2"),
            (rf"([^{space}])([\x09-\x0d])", rf"\1{CUT}\2"),
            (" ", f"{CUT} "),
            (rf"([{space}]){CUT}", r"\1"),  # not within white space
        ]
        # The ids of unit k are those of `ids` behind the first sum(sizes[:k]).
        self.number: dict[str, int] = {}
        self.ids, self.sizes = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an order of the units, their ids in it, how many each has) of units that begin and end where pieces do.

        All are encoded as one sequence, but what plainly is one piece goes to the merges directly.
        """
        plain = np.fromiter((self.piece.fullmatch(u) is not None for u in units), bool, len(units))
        made = []
        for own, tokenizer in ((np.flatnonzero(plain), self.merges), (np.flatnonzero(~plain), self.tokenizer)):
            words = [units[k] for k in own.tolist()]
            if words and tokenizer is self.merges:
                words = self.letters[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n")
            seq = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            made.append((own, np.array(seq.ids, dtype="<u4"), np.bincount(np.array(seq.word_ids, dtype=np.int64), minlength=len(own))))
        return tuple(np.concatenate(x) for x in zip(*made))

    def _known(self, units: list[str]) -> np.ndarray:
        """The numbers of distinct units, remembered or new; when there are too many, only those of this call stay."""
        number = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(number < 0)
        if len(new):
            if len(self.number) + len(new) > CACHE_UNITS:
                kept = np.flatnonzero(number >= 0)
                self.ids, self.sizes = gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[number[kept]], self.sizes[number[kept]]), self.sizes[number[kept]]
                number[kept] = np.arange(len(kept))
                self.number = dict(zip([units[k] for k in kept.tolist()], range(len(kept))))
            order, ids, sizes = self._encode([units[k] for k in new.tolist()])
            number[new[order]] = np.arange(len(new)) + len(self.number)
            self.number.update(zip([units[k] for k in new.tolist()], number[new].tolist()))
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return number

    def _units(self, texts: pa.Array) -> pa.Array:
        """Each text's units, in order."""
        for pattern, by in self.cuts:
            texts = (pc.replace_substring if pattern == " " else pc.replace_substring_regex)(texts, pattern, by)
        return pc.split_pattern(texts, CUT)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has) of strings without nulls."""
        odd = pc.match_substring_regex(texts, self.odd)
        cut = self._units(pc.if_else(odd, "", texts))
        units = cut.values.dictionary_encode()
        number = self._known(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, sizes, starts = self.ids, self.sizes[number], (np.cumsum(self.sizes) - self.sizes)[number]
        unit, offsets = np.array(units.indices), np.asarray(cut.offsets)
        whole = np.flatnonzero(odd)
        if len(whole):
            made = [np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype="<u4") for k in whole.tolist()]
            more = np.array([len(ids) for ids in made])
            unit[offsets[whole]] = len(sizes) + np.arange(len(whole))
            flat, sizes, starts = np.concatenate([flat, *made]), np.r_[sizes, more], np.r_[starts, len(flat) + np.cumsum(more) - more]
        count = sizes[unit]
        return gather(flat, starts[unit], count), np.diff(np.r_[0, np.cumsum(count)][offsets])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, sizes = self.column(pa.array(texts, pa.string()).fill_null(""))
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


FILE_SCHEMA = "shard int, chunk int, first_id long, n_ids long, doc_ids array<bigint>, doc_sizes array<bigint>, words binary, block_words binary, escapes binary"


def groups(batch: pa.RecordBatch):
    """The rows of a batch in slices of about GROUP_BYTES of text (column 2), a row at least."""
    if batch.num_rows:
        group = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def write_token_file(docs: DataFrame, out: str, tokenizer: str = TOKENIZER, shards: int | None = None, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every whole text and write the ids in ascending doc_id order to the Parquet folder out.

    Shards are ranges of (doc_id, hash of the text), about SHARD_BYTES of text each, so neither a hot doc_id nor a hot text
    meets in one task; rows that repeat both do.
    """
    spark = docs.sparkSession
    size = 0 if shards else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    rows = rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("block_words", pa.binary()), ("escapes", pa.binary())])

    def run(batches):
        encode, chunk, first, shard = encoder(tokenizer).column, 0, 0, 0
        keys, arrays, held = [], [], 0

        def close():
            nonlocal chunk, first, keys, arrays, held
            words, starts, escapes = pack(np.concatenate(arrays))
            row = [shard, chunk, first, held, keys, [len(a) for a in arrays], words.astype("<u8").tobytes(), starts.astype("<i8").tobytes(), escapes.astype("<u8").tobytes()]
            chunk, first, keys, arrays, held = chunk + 1, first + held, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part in groups(batch):
                ids, sizes = encode(part.column(2))
                ends = np.cumsum(sizes)
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                for shard, key, a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    if held and held + b - a > chunk_ids:
                        yield close()
                    keys.append(key)
                    arrays.append(ids[a:b])
                    held += b - a
        if held:
            yield close()

    rows.mapInArrow(run, FILE_SCHEMA).write.parquet(out)


def read_token_file(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, decoded from the file: doc_id, start, n_tokens, ids_crc32 (and ids).

    A shard's place in the whole comes from the sums of the shards before it.
    """
    chunks = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    base = totals.selectExpr("shard", "coalesce(sum(_n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _base")  # a row per shard

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = unpack(np.frombuffer(one["words"], "<u8"), np.frombuffer(one["block_words"], "<i8"), np.frombuffer(one["escapes"], "<u8"), one["n_ids"])
                sizes = np.array(one["doc_sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                flat = ids.astype("<u4")
                made = [
                    pa.array(one["doc_ids"], pa.int64()),
                    pa.array(ends - sizes + one["_base"] + one["first_id"], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(flat[e - s : e]) for s, e in zip(sizes, ends)], pa.int64()),
                ]
                if with_ids:
                    made.append(pa.array([ids[e - s : e].astype(np.int64) for s, e in zip(sizes, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return chunks.join(F.broadcast(base), "shard").mapInArrow(run, schema)


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    out = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_token_file(table(spark, sf_dir, "documents"), out)
    return read_token_file(spark, out)
