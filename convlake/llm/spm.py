"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

One pass over a unit of text reports every vocabulary piece that ends at each position (the
automaton follows its output links); each relaxes the best score of its end. Letters that no path
covers fall back to byte pieces.

Pieces of the published model never hold a space mark after another letter, nor a line break, so
the best segmentation of a text is that of its units `space marks + letters`, one after another;
units are remembered. (Checked when the model is read; otherwise whole texts are single units.)
The model's pieces are ranked, not weighted: `scores="zipf"` gives the piece of rank r the log
probability -ln(r + 2), `scores="model"` the stored scores. Equal scores: the longer last piece.

Edge cases: null text stays null (no ids); an empty text has no ids; a literal space mark (U+2581)
in a text is encoded as bytes, so decoding gives back every text exactly; repeated rows are encoded
one by one; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
CACHE_UNITS = 250_000
UNITS = re.compile("\n|▁*[^▁\n]+|▁+")


class Codec:
    def __init__(self, path: str = PIECES, scores: str = "zipf"):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i):
                self.table.append(b"")
            elif model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            else:
                self.table.append(piece.replace(MARK, " ").encode())
                self.pieces[piece] = (i, model.get_score(i))
        if scores == "zipf":
            rank = sorted(self.pieces, key=lambda p: -self.pieces[p][1])
            self.pieces = {p: (self.pieces[p][0], -float(np.log(r + 2))) for r, p in enumerate(rank)}
        self.byte_score = min(s for _, s in self.pieces.values()) - 1
        self.whole = any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces)
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in self.pieces.items():
            self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()
        self.cache: dict[str, bytes] = {}

    def best(self, unit: str) -> list[int]:
        """The ids of the best segmentation of a unit."""
        n, never = len(unit), -float("inf")
        score, back, taken = [never] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0], at = 0.0, 0

        def close(until: int) -> None:
            # Positions that no piece reaches get there by the bytes of the letter before.
            nonlocal at
            while at < until:
                at += 1
                if score[at] == never or unit[at - 1] not in self.pieces:
                    by_bytes = score[at - 1] + self.byte_score * len(unit[at - 1].encode(errors="surrogatepass"))
                    if by_bytes > score[at]:
                        score[at], back[at], taken[at] = by_bytes, at - 1, -1

        for end, (length, gain, i) in self.automaton.iter(unit):
            if at < end:
                close(end)
            x = score[end + 1 - length] + gain
            if x > score[end + 1]:
                score[end + 1], back[end + 1], taken[end + 1] = x, end + 1 - length, i
        close(n)
        ids: list[int] = []
        while n:
            if taken[n] >= 0:
                ids.append(taken[n])
            else:
                ids += [self.byte_id[b] for b in reversed(unit[back[n] : n].encode(errors="surrogatepass"))]
            n = back[n]
        return ids[::-1]

    def _marked(self, text: str) -> bytes:
        cache = self.cache
        units = [text] if self.whole else UNITS.findall(text)
        try:
            return b"".join([cache[u] for u in units])
        except KeyError:
            if len(cache) > CACHE_UNITS:
                cache.clear()
            for u in units:
                if u not in cache:
                    cache[u] = np.array(self.best(u), dtype="<u4").tobytes()
            return b"".join([cache[u] for u in units])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        first, *rest = text.split(MARK)
        out = self._marked(MARK + first.replace(" ", MARK))
        if rest:
            mark = np.array([self.byte_id[b] for b in MARK.encode()], dtype="<u4").tobytes()
            out += b"".join(mark + self._marked(r.replace(" ", MARK)) for r in rest)
        return np.frombuffer(out, dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw[1:].decode(errors="surrogatepass") if raw[:1] == b" " else raw.decode(errors="replace")


@lru_cache(maxsize=2)
def codec(path: str, scores: str) -> Codec:
    return Codec(path, scores)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if a is None else len(a) for a in arrays]
    offsets = pa.array([None if a is None else o for a, o in zip(arrays, np.cumsum([0, *sizes[:-1]]))] + [sum(sizes)], pa.int32())
    flat = np.concatenate([a for a in arrays if a is not None] or [np.empty(0)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))


def _with(df: DataFrame, fn, added: list[T.StructField], source: str) -> DataFrame:
    """df with the columns that fn makes of the column source, batch by batch of bounded text."""
    names = [f.name for f in added]
    keep = [c for c in df.columns if c not in names or c == source]
    schema = T.StructType([df.schema[c] for c in keep if c not in names] + added)

    def run(batches):
        for batch in batches:
            size = 256  # rows at a time: what is made of them is held at once
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                made = fn(part.column(source).to_pylist())
                kept = [(part.column(c), c) for c in keep if c not in names]
                yield pa.RecordBatch.from_arrays([*(k for k, _ in kept), *made], [*(c for _, c in kept), *names])

    return df.select(*keep).mapInArrow(run, schema)


def encode(df: DataFrame, path: str = PIECES, text: str = "text", ids: str = "ids", scores: str = "zipf") -> DataFrame:
    """df with the ids of each whole text."""
    field = T.StructField(ids, T.ArrayType(T.IntegerType()))
    return _with(df, lambda texts: [_lists([None if t is None else codec(path, scores).encode(t) for t in texts])], [field], text)


def decode(df: DataFrame, path: str = PIECES, ids: str = "ids", text: str = "decoded", scores: str = "zipf") -> DataFrame:
    """df with the text that the ids stand for."""
    field = T.StructField(text, T.StringType())
    return _with(df, lambda rows: [pa.array([None if r is None else codec(path, scores).decode(np.array(r, dtype=np.int64)) for r in rows], pa.string())], [field], ids)


def encode_checked(df: DataFrame, path: str = PIECES, text: str = "text", scores: str = "zipf", with_ids: bool = True) -> DataFrame:
    """Encode, decode again in the same task, and say whether the text came back.

    Adds n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), round_trip, and ids.
    """

    def made(texts):
        coder = codec(path, scores)
        rows = [None if t is None else coder.encode(t) for t in texts]
        n = pa.array([0 if r is None else len(r) for r in rows], pa.int64())
        crc = pa.array([zlib.crc32(b"" if r is None else r.tobytes()) for r in rows], pa.int64())
        same = pa.array([r is None or coder.decode(r) == t for r, t in zip(rows, texts)], pa.bool_())
        return [n, crc, same, *([_lists(rows)] if with_ids else [])]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return _with(df, made, fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids, text)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_checked(docs, with_ids=False).select("doc_id", "n_tokens", "ids_crc32", "round_trip")
