"""Alignment of two tokenizers against the libraries on whole texts, whatever the cuts and the tree of composition."""

import hashlib
import random
from collections import Counter
from functools import lru_cache, reduce

import pytest
from pyspark.sql import functions as F

from convlake.llm import tokenalign as ta

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
LETTERS = ["a", "B", "é", "ß", "日", "本", "🙂", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "0", "12", ".", "'s", "'", "-", "the", " of", "<s>", "<|endoftext|>", "́", "\x00", "ing"]


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(1, 90))) for _ in range(n)]


@lru_cache(maxsize=1)
def made():
    return ta.aligner(ta.SIDE_A, ta.SIDE_B)


def whole(text):
    """(ids of A, ids of B, groups, links) with the libraries on the whole text, by bytes."""
    m = made()
    a, b = m.tok_a.encode(" " + text, add_special_tokens=False).ids if text else [], m.tok_b.encode(text) if text else []
    raw = (" " + (text or "")).encode()
    pieces = [bytes([int(p[3:5], 16)]) if m.tok_b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [m.tok_b.id_to_piece(i)]]
    if not text or b"".join(pieces) != raw or b"".join(m.bytes_a[i] for i in a) != raw:
        return [], [], [], []
    spans, at = [[], []], 0
    for side, sizes in zip(spans, ([len(m.bytes_a[i]) for i in a], [len(p) for p in pieces])):
        at = 0
        for s in sizes:
            side.append((at, at + s))
            at += s
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for high in common:
        groups.append(tuple([i for i, (_, e) in zip(ids, side) if low < e <= high] for ids, side in zip((a, b), spans)))
        low = high
    links, j = [], 0
    for i, (s, e) in zip(a, spans[0]):
        links += [(i, b[k]) for k, (t, f) in enumerate(spans[1]) if t < e and f > s] if len(b) < 400 else []
    return a, b, groups, links


def text_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def test_units_give_what_whole_texts_give():
    texts = [None, "", " ", "▁", "a▁b", "the  end ", "\n", *odd_texts()]
    for text, found in zip(texts, made().documents(texts)):
        a, b, groups, links = whole(text)
        if found is None:
            assert not a
            continue
        closed, n_a, n_b = found
        assert (n_a, n_b, closed.groups, closed.text) == (len(a), len(b), len(groups), text_of(groups)), repr(text)
        assert Counter(links) == {(p >> ta.SHIFT, p & ((1 << ta.SHIFT) - 1)): t for p, t in zip(closed.pairs.tolist(), closed.times.tolist())}
    assert sum(x is not None for x in made().documents(texts)) > 200


def test_fragments_compose_in_any_tree():
    m, rng, uncommon = made(), random.Random(9), 0
    for text in [t for t in odd_texts(150, 6) if t] + ["x" * 200, "a\tb\tc d\te\n\n f"]:
        a, b, groups, links = whole(text)
        for size in (1, 3, 7, 40, 1000):
            parts = [m.ranged(raw, at, *ranges) for at, *ranges, raw in ta.chop(text, size)]
            uncommon += sum(bool(f.cut and len(f.suffix.a)) for f in parts[:-1])
            left = reduce(m.compose, parts)
            right = reduce(lambda y, x: m.compose(x, y), reversed(parts))
            tree = list(parts)
            while len(tree) > 1:
                k = rng.randrange(len(tree) - 1)
                tree[k : k + 2] = [m.compose(tree[k], tree[k + 1])]
            for f in (left, right, tree[0]):
                closed = m.finish(f)
                assert (closed is not None) == bool(a), (text, size)
                if a:
                    assert (f.n_a, f.n_b, closed.groups, closed.text, closed.links) == (len(a), len(b), len(groups), text_of(groups), len(links)), (text, size)
    assert uncommon > 20


def brute(rows):
    """The contract's columns by plain loops over all documents."""
    found = [(i, *whole(t)) for i, t in rows]
    held = Counter(p for *_, links in found for p in set(links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for i, a, b, groups, links in found:
        digest = hashlib.sha256(text_of(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes, broadcast_pairs", [(40, 0), (ta.CHUNK_BYTES, ta.BROADCAST_PAIRS)])
def test_query_against_brute_force(spark, chunk_bytes, broadcast_pairs):
    rows = [(k, t) for k, t in enumerate(odd_texts(60, 8))] + [(900, None), (901, ""), (902, "a▁b"), (3, "the same"), (3, "the same"), (None, "the end"), (904, "the same")]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS).withColumn("pairs", F.lit(1)).withColumn("uid", F.lit("x")).repartition(3)
    aligned = ta.align(df, chunk_bytes=chunk_bytes)
    got = ta.scored(aligned, ta.pair_counts(aligned), broadcast_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_long_documents_are_shared_out(spark):
    text = " ".join(f"word{k % 91}\tx{k}" for k in range(9000))
    df = spark.createDataFrame([(1, text, "en"), (2, "x" * 70000, "en"), (3, text[:500], "en")], DOCS)
    rows = {r.doc_id: r for r in ta.align(df, with_groups=True).collect()}
    again = {r.doc_id: r for r in ta.align(df, chunk_bytes=1 << 30, with_groups=True).collect()}
    for k in (1, 2, 3):
        assert rows[k].groups == again[k].groups and rows[k].n_links == again[k].n_links and dict(zip(rows[k].pairs, rows[k].times)) == dict(zip(again[k].pairs, again[k].times))
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256


def test_real_documents_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    few = docs.where("length(text) < 700")
    aligned = ta.align(few)
    got = ta.scored(aligned, ta.pair_counts(aligned))
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == brute([tuple(r) for r in few.collect()])
    none = ta.align(spark.createDataFrame([], DOCS))
    assert ta.scored(none, ta.pair_counts(none)).count() == 0
