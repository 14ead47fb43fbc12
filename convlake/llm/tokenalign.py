"""Alignment of two tokenizers: groups of tokens between the bytes where both end, and their links.

Fragments form a monoid. A fragment covers the tokens of a byte range of a document: an open prefix
up to the first place where tokens of both sides end, groups that are closed, and an open suffix.
`compose` puts a fragment behind another: the open ends that meet are joined, and what ends on both
sides closes. It is associative, so a document's fragments can be composed in any tree.

A document of up to `chunk_bytes` is composed in one task. A longer one is dealt in byte ranges to
tasks; each side begins its range at the first place behind the border where its tokenizer surely
ends a token, so the two sides of a fragment need not begin or end together. Fragments of one
document meet in rounds of FAN at a time. Words in between are remembered, as small fragments.

How many documents hold a pair of ids is counted by Spark over all documents, and joined back: as a
broadcast while the distinct pairs are `BROADCAST_PAIRS` at most, by shuffle beyond, where the few pairs that
hold a thousandth of all rows or more are split off.

Edge cases: a text that is null, empty, or that either side doesn't give back byte for byte has no
tokens (zeros, and '' for the digest); repeated rows are documents of their own; texts without any
place to cut are one range, of any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import join_groups, materialise, table

SIDE_A, SIDE_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
SHIFT = 24  # a pair is the id of A, shifted, and the id of B
PAIR_BITS = 48  # of a pair; above them a text's place in a group
CHUNK_BYTES = 32_768
FAN = 8
GROUP = 128  # documents whose rows are held at once
CACHE_UNITS, CACHE_LETTERS, LEARN_UNITS = 250_000, 10_000_000, 20_000
BROADCAST_PAIRS = 1_000_000
NONE = np.empty(0, np.int64)

# Both sides end a token before a space or line break that follows something other than white space.
UNITS = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
BOTH = re.compile(r"(?<=\S)(?=[ \n])")
# Side A does before any white space that follows something else, side B before spaces that follow
# another letter, and around line breaks. In UTF-8; the sequences are white space beyond ASCII.
CUT_A = re.compile(rb"(?<=[\x21-\x7e\x80-\xbf])(?<!\xc2\x85)(?<!\xc2\xa0)(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)(?=[ \t-\r])")
CUT_B = re.compile(rb"(?<=[^ ])(?=[ \n])")


class Open:
    """Tokens of both sides that no common end closes yet; the sides may begin at different bytes."""

    def __init__(self, a=NONE, b=NONE, a_from: int = 0, b_from: int = 0):
        self.a, self.b, self.a_from, self.b_from = a, b, a_from, b_from

    def then(self, other: "Open") -> "Open":
        return Open(
            np.concatenate([self.a, other.a]), np.concatenate([self.b, other.b]), self.a_from if len(self.a) else other.a_from, self.b_from if len(self.b) else other.b_from
        )


class Closed:
    """Groups: their text, their number, and their links as pairs of ids with how often each occurs."""

    def __init__(self, text: str = "", groups: int = 0, links: int = 0, pairs=NONE, times=NONE):
        self.text, self.groups, self.links, self.pairs, self.times = text, groups, links, pairs, times

    def then(self, other: "Closed") -> "Closed":
        if not other.groups or not self.groups:
            return self if self.groups else other
        return Closed(f"{self.text};{other.text}", self.groups + other.groups, self.links + other.links, *summed(np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times])))


class Fragment:
    """cut: a common end is known, so prefix and suffix are apart; else all tokens are in prefix. ok: every text was given back."""

    def __init__(self, prefix: Open, closed: Closed = Closed(), suffix: Open = Open(), cut: bool = False, n_a: int = 0, n_b: int = 0, ok: bool = True):
        self.prefix, self.closed, self.suffix, self.cut, self.n_a, self.n_b, self.ok = prefix, closed, suffix, cut, n_a, n_b, ok


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, times)
    return found, total


class Aligner:
    def __init__(self, side_a: str = SIDE_A, side_b: str = SIDE_B):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok_a = Tokenizer.from_file(side_a)
        self.tok_a.encode_special_tokens = True
        self.tok_b = sentencepiece.SentencePieceProcessor(model_file=side_b)
        self.space = self.tok_b.piece_to_id(MARK)
        byte = _byte_letters()
        with open(side_a, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max(max(entries.values()), *self.tok_a.get_added_tokens_decoder()))
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.tok_b.id_to_piece(i) for i in range(self.tok_b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.tok_b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        """Units: number by text, and of each its counts, its text, and its links."""
        self.number: dict[str, int] = {}
        self.counts = np.empty((0, 5), np.int64)  # tokens of A and B, groups, links, and 1 if not given back
        self.texts: list[str] = []
        self.links, self.link_at = NONE, NONE
        self.letters = 0

    # The two encoders -----------------------------------------------------------------------

    def encode_b(self, spans: list[str]) -> list[list[int]]:
        """Spans begin with a space or a line break, where a token begins; the library puts a space in front of what isn't empty."""
        found = self.tok_b.encode([s[1:] if s[:1] == " " else s for s in spans], num_threads=1)
        return [[self.space] if s == " " else ids if s[:1] == " " else ids[1:] for s, ids in zip(spans, found)]

    def tokens(self, a: str, b: str, a_from: int = 0, b_from: int = 0) -> tuple[Open, bool]:
        """The tokens of a span of each side, and whether they give the spans back."""
        ids_a = self.tok_a.encode(a, add_special_tokens=False).ids if a else []
        ids_b = self.encode_b([b])[0] if b else []
        ok = b"".join(map(self.bytes_a.__getitem__, ids_a)) == a.encode() and b"".join(map(self.bytes_b.__getitem__, ids_b)) == b.encode()
        return Open(np.array(ids_a, np.int64), np.array(ids_b, np.int64), a_from, b_from), ok

    # The monoid -----------------------------------------------------------------------------

    def ends(self, o: Open) -> tuple[np.ndarray, np.ndarray]:
        return o.a_from + np.cumsum(self.size_a[o.a]), o.b_from + np.cumsum(self.size_b[o.b])

    def groups(self, o: Open) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens whose last ends are common: the texts of their groups and where these end, and all links as pairs, with the ends of A."""
        ends_a, ends_b = self.ends(o)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stop_a, stop_b = (np.searchsorted(e, common).tolist() for e in (ends_a, ends_b))
        names_a, names_b = list(map(str, o.a.tolist())), list(map(str, o.b.tolist()))
        texts, i, j = [], 0, 0
        for s, t in zip(stop_a, stop_b):
            if s == i and t == j:
                texts.append(f"{names_a[i]}|{names_b[j]}")
            else:
                texts.append(f"{','.join(names_a[i : s + 1])}|{','.join(names_b[j : t + 1])}")
            i, j = s + 1, t + 1
        first = np.searchsorted(ends_b, ends_a - self.size_a[o.a], "right")
        many = np.searchsorted(ends_b, ends_a) - first + 1
        of_b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        return texts, common, (np.repeat(o.a, many) << SHIFT) | o.b[of_b], np.repeat(ends_a, many)

    def close(self, o: Open) -> Closed:
        """The groups of tokens whose last ends are common."""
        if not len(o.a):
            return Closed()
        texts, _, links, _ = self.groups(o)
        pairs, times = np.unique(links, return_counts=True)
        return Closed(";".join(texts), len(texts), len(links), pairs, times.astype(np.int64))

    def split(self, o: Open) -> tuple[Open, Closed, Open] | None:
        """(tokens up to the first common end, groups up to the last one, tokens behind it); None without a common end."""
        ends_a, ends_b = self.ends(o)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(common):
            return None
        a0, a1 = np.searchsorted(ends_a, common[[0, -1]]) + 1
        b0, b1 = np.searchsorted(ends_b, common[[0, -1]]) + 1
        low, high = int(common[0]), int(common[-1])
        return Open(o.a[:a0], o.b[:b0], o.a_from, o.b_from), self.close(Open(o.a[a0:a1], o.b[b0:b1], low, low)), Open(o.a[a1:], o.b[b1:], high, high)

    def fragment(self, o: Open, ok: bool = True) -> Fragment:
        n = (len(o.a), len(o.b))
        parts = self.split(o)
        return Fragment(*parts, True, *n, ok) if parts else Fragment(o, n_a=n[0], n_b=n[1], ok=ok)

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        n = (x.n_a + y.n_a, x.n_b + y.n_b, x.ok and y.ok)
        if not x.cut and not y.cut:
            made = self.fragment(x.prefix.then(y.prefix))
            made.ok = n[2]
            return made
        meet = (x.suffix if x.cut else x.prefix).then(y.prefix)
        if x.cut and y.cut:
            return Fragment(x.prefix, x.closed.then(self.close(meet)).then(y.closed), y.suffix, True, *n)
        if x.cut:
            parts = self.split(meet)
            if not parts:
                return Fragment(x.prefix, x.closed, meet, True, *n)
            first, closed, rest = parts
            return Fragment(x.prefix, x.closed.then(self.close(first)).then(closed), rest, True, *n)
        first, closed, _ = self.split(meet) or (meet, Closed(), None)
        return Fragment(first, closed.then(y.closed), y.suffix, True, *n)

    def finish(self, f: Fragment) -> Closed | None:
        """The groups of a document's whole fragment; None if a text wasn't given back."""
        whole = f.ok and not (len(f.suffix.a) or len(f.suffix.b)) and (f.cut or not (len(f.prefix.a) or len(f.prefix.b)))
        return self.close(f.prefix).then(f.closed) if whole else None

    # Texts ----------------------------------------------------------------------------------

    def learn(self, units: list[str]) -> None:
        """Remember units, each of which is a closed fragment: all are closed as one sequence and taken apart again."""
        if not units:
            return
        made = self.tok_a.encode(units, is_pretokenized=True, add_special_tokens=False)
        bounds = np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(units) + 1)).tolist()
        flat = made.ids
        ids_a, ids_b = [flat[lo:hi] for lo, hi in zip(bounds, bounds[1:])], self.encode_b(units)
        raw = [u.encode() for u in units]
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        bad = [b"".join(map(of_a, a)) != r or b"".join(map(of_b, b)) != r for a, b, r in zip(ids_a, ids_b, raw)]
        good = [k for k, x in enumerate(bad) if not x]
        counts = np.zeros((len(units), 5), np.int64)
        counts[:, 0], counts[:, 1], counts[:, 4] = list(map(len, ids_a)), list(map(len, ids_b)), bad
        texts, links, sizes = [""] * len(units), NONE, np.zeros(len(units), np.int64)
        if good:
            whole = Open(np.array([i for k in good for i in ids_a[k]], np.int64), np.array([i for k in good for i in ids_b[k]], np.int64))
            parts, ends, links, link_ends = self.groups(whole)
            borders = np.cumsum([len(raw[k]) for k in good])
            stops = np.searchsorted(ends, borders, "right")
            counts[good, 2] = np.diff(stops, prepend=0)
            counts[good, 3] = sizes[good] = np.diff(np.searchsorted(link_ends, borders, "right"), prepend=0)
            for k, lo, hi in zip(good, [0, *stops.tolist()], stops.tolist()):
                texts[k] = ";".join(parts[lo:hi])
        self.number.update(zip(units, range(len(self.texts), len(self.texts) + len(units))))
        self.link_at = np.concatenate([self.link_at, len(self.links) + np.cumsum(sizes) - sizes])
        self.links = np.concatenate([self.links, links])
        self.counts = np.concatenate([self.counts, counts])
        self.texts += texts

    def units(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of the units of each text."""
        new = {u for t in texts for u in t if u not in self.number}
        if len(self.number) + len(new) > CACHE_UNITS or self.letters > CACHE_LETTERS:
            self.forget()
            new = {u for t in texts for u in t}
        self.letters += sum(map(len, new))
        order = sorted(new)
        for k in range(0, len(order), LEARN_UNITS):
            self.learn(order[k : k + LEARN_UNITS])
        return [list(map(self.number.__getitem__, t)) for t in texts]

    def closed(self, texts: list[list[int]]) -> list[tuple[Closed, int, int] | None]:
        """(groups, tokens of A, tokens of B) of each text, as numbers of units one behind the other; None without units, or if one wasn't given back."""
        owner = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        numbers = np.array([u for t in texts for u in t], np.int64)
        total = np.zeros((len(texts), 5), np.int64)
        np.add.at(total, owner, self.counts[numbers])
        sizes = self.counts[numbers, 3]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.link_at[numbers], sizes)
        keys, times = np.unique((np.repeat(owner, sizes) << PAIR_BITS) | self.links[at], return_counts=True)
        stops = np.searchsorted(keys >> PAIR_BITS, np.arange(len(texts) + 1))
        pairs, times = keys & ((1 << PAIR_BITS) - 1), times.astype(np.int64)
        out: list[tuple[Closed, int, int] | None] = []
        for k, (t, (n_a, n_b, groups, links, bad)) in enumerate(zip(texts, total.tolist())):
            here = slice(stops[k], stops[k + 1])
            out.append((Closed(";".join(map(self.texts.__getitem__, t)), groups, links, pairs[here], times[here]), n_a, n_b) if t and not bad else None)
        return out

    def documents(self, texts: list[str | None]) -> list[tuple[Closed, int, int] | None]:
        return self.closed(self.units([UNITS.findall(" " + t) if t and MARK not in t else [] for t in texts]))

    def ranged(self, raw: bytes, at: int, a_from: int, a_to: int, b_from: int, b_to: int) -> Fragment:
        """The fragment of the tokens of A and B in their byte ranges; raw begins at byte `at`."""
        spans = lambda lo_a, hi_a, lo_b, hi_b: self.tokens(raw[lo_a - at : hi_a - at].decode(), raw[lo_b - at : hi_b - at].decode(), lo_a, lo_b)
        low, high = max(a_from, b_from), min(a_to, b_to)
        inner = raw[low - at : high - at].decode() if low < high else ""
        cuts = [0] if inner and a_from == b_from else []
        cuts += [m.start() for m in (BOTH.search(inner),) if m]
        last = max((m.start() for m in BOTH.finditer(inner, cuts[0])), default=-1) if cuts else -1
        if not cuts or last <= cuts[0]:
            return self.fragment(*spans(a_from, a_to, b_from, b_to))
        body = inner[cuts[0] : last]
        first = low + len(inner[: cuts[0]].encode())
        behind = first + len(body.encode())
        found = self.closed(self.units([UNITS.findall(body)]))[0]
        head = self.fragment(*spans(a_from, first, b_from, first))
        middle = Fragment(Open(), found[0], Open(), True, found[1], found[2]) if found else Fragment(Open(), ok=False, cut=True)
        tail = self.fragment(*spans(behind, a_to, behind, b_to))
        return reduce(self.compose, [head, middle, tail])


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it can be seen in Latin-1, else the next letter from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def aligner(side_a: str, side_b: str) -> Aligner:
    return Aligner(side_a, side_b)


ALIGNED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>"
GROUPS = ", groups string"
CHUNKS = "uid long, doc_id long, no long, chunks long, at long, a_from long, a_to long, b_from long, b_to long, raw binary"
FRAGMENTS = (
    "uid long, doc_id long, no long, chunks long, ok boolean, cut boolean, n_a long, n_b long, text string, n_groups long, n_links long, pairs array<bigint>, times array<bigint>, "
    "pre_a array<bigint>, pre_b array<bigint>, pre_a_from long, pre_b_from long, suf_a array<bigint>, suf_b array<bigint>, suf_a_from long, suf_b_from long"
)


KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))


def _judged(uid, doc_id, found: tuple[Closed, int, int] | None, with_groups: bool) -> tuple:
    if not found:
        return (uid, doc_id, 0, 0, 0, 0, "", NONE, NONE, *[""] * with_groups)
    closed, n_a, n_b = found
    return (uid, doc_id, n_a, n_b, closed.groups, closed.links, hashlib.sha256(closed.text.encode()).hexdigest(), closed.pairs, closed.times, *[closed.text] * with_groups)


def chop(text: str, chunk_bytes: int):
    """(begin, range of A, range of B, bytes) of each byte range of a space and the text."""
    raw = (" " + text).encode()
    borders = range(chunk_bytes, len(raw), chunk_bytes)
    at = [[0, *[m.start() if (m := cut.search(raw, x)) else len(raw) for x in borders], len(raw)] for cut in (CUT_A, CUT_B)]
    for a_from, a_to, b_from, b_to in zip(at[0], at[0][1:], at[1], at[1][1:]):
        begin = min(a_from, b_from)
        yield begin, a_from, a_to, b_from, b_to, raw[begin : max(a_to, b_to)]


def _row(uid, doc_id, no, chunks, f: Fragment) -> tuple:
    p, s, c = f.prefix, f.suffix, f.closed
    return (uid, doc_id, no, chunks, f.ok, f.cut, f.n_a, f.n_b, c.text, c.groups, c.links, c.pairs, c.times, p.a, p.b, p.a_from, p.b_from, s.a, s.b, s.a_from, s.b_from)


def _unrow(r: dict) -> Fragment:
    ids = lambda c: np.array(r[c], np.int64)
    return Fragment(
        Open(ids("pre_a"), ids("pre_b"), r["pre_a_from"], r["pre_b_from"]), Closed(r["text"], r["n_groups"], r["n_links"], ids("pairs"), ids("times")),
        Open(ids("suf_a"), ids("suf_b"), r["suf_a_from"], r["suf_b_from"]), r["cut"], r["n_a"], r["n_b"], r["ok"],
    )


def align(df: DataFrame, id: str = "doc_id", text: str = "text", side_a: str = SIDE_A, side_b: str = SIDE_B, chunk_bytes: int = CHUNK_BYTES, with_groups: bool = False) -> DataFrame:
    """A written table with a row for each of df: ALIGNED, and the groups themselves if asked for."""
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    long = F.octet_length(F.coalesce("text", F.lit(""))) >= chunk_bytes
    schema = ALIGNED + GROUPS * with_groups

    def whole(batches):
        made = aligner(side_a, side_b)
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                uids, ids, texts = (c.to_pylist() for c in batch.slice(a, GROUP).columns)
                yield _batch([_judged(u, i, f, with_groups) for u, i, f in zip(uids, ids, made.documents(texts))], schema)

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                uid, doc_id, one = (c[k].as_py() for c in batch.columns)
                n = len(range(0, len(one.encode()) + 1, chunk_bytes))
                for no, (begin, *ranges, raw) in enumerate(chop(one, chunk_bytes)):
                    yield _batch([(uid, doc_id, no, n, begin, *ranges, raw)], CHUNKS)

    def fragments(batches):
        made = aligner(side_a, side_b)
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                f = Fragment(Open(), ok=False, cut=True) if MARK.encode() in r["raw"] else made.ranged(*(r[c] for c in ("raw", "at", "a_from", "a_to", "b_from", "b_to")))
                yield _batch([_row(r["uid"], r["doc_id"], r["no"], r["chunks"], f)], FRAGMENTS)

    def joined(few: pa.Table, last: bool) -> pa.Table:
        """One fragment of up to FAN neighbours; in the last round the document's row."""
        made = aligner(side_a, side_b)
        found = sorted(few.to_pylist(), key=lambda r: r["no"])
        first, f = found[0], reduce(made.compose, map(_unrow, found))
        if last:
            closed = made.finish(f)
            return pa.Table.from_batches([_batch([_judged(first["uid"], first["doc_id"], closed and (closed, f.n_a, f.n_b), with_groups)], schema)])
        return pa.Table.from_batches([_batch([_row(first["uid"], first["doc_id"], first["no"] // FAN, -(-first["chunks"] // FAN), f)], FRAGMENTS)])

    def step(last: bool):
        return lambda few: joined(few, last)

    chunks = materialise(rows.where(long).mapInArrow(cut, CHUNKS), "align-chunks")
    size = chunks.agg(F.max("chunks"), F.sum(F.octet_length("raw"))).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, (size[1] or 0) // 4_000_000)
    pieces = chunks.repartition(tasks, "uid", "no").mapInArrow(fragments, FRAGMENTS)
    short = rows.where(~long).mapInArrow(whole, schema)
    if not size[0]:
        return materialise(short, "aligned")
    left = size[0]
    while left > 1:
        last, left = left <= FAN, -(-left // FAN)
        pieces = pieces.groupBy("uid", F.expr(f"no div {FAN}").alias("node")).applyInArrow(step(last), schema if last else FRAGMENTS)
    return materialise(short.unionByName(pieces), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, docs (that hold it linked), best (whether no pair of its A id is in more): a written table."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    of_a = Window.partitionBy(F.shiftright("pair", SHIFT))  # at most as many rows as B has ids
    return materialise(counts.select("pair", "docs", (F.col("docs") == F.max("docs").over(of_a)).alias("best")), "align-pairs")


def scored(aligned: DataFrame, pairs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The aligned documents with n_best and count_sum."""
    links = aligned.select("uid", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    met = links.join(F.broadcast(pairs), "pair") if pairs.count() <= broadcast_pairs else join_groups(links, pairs, "pair", "docs")
    sums = met.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("pairs", "times").join(sums, "uid", "left").select(*[c for c in aligned.columns if c not in ("pairs", "times", "uid")], zero("n_best"), zero("count_sum"))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"))
    return scored(aligned, pair_counts(aligned)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
