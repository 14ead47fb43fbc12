"""The corpus operators against brute force, exact round trips and held-out accuracy, with the odd cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from convlake.llm import cws, decontaminate, fixity, langid, licences, registry, simhash, spm, tokenfile, urlfilter, wrappers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}" for k in range(30000))
ODD = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "Hello  wörld\n▁ x", None, "a", 5), (4, "Hello  wörld\n▁ x", None, "a", 5),
    (None, "null id here", "de", "b", 3), (5, LONG, "en", "a", 1), (6, LONG + " tail", "en", "a", 1), (6, "same id", "fr", "a", 1), (6, "same id", "fr", "a", 1),
    (7, " \t\n", "en", "a", 1), (8, "!!! 123", "en", "a", 1), (9, "日本語テキスト", None, "c", 1),
]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# 1 --------------------------------------------------------------------------------------------

def test_fixity_finds_what_differs(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "x" * (k % 700) * 9) for k in range(3000)] + [(7, "u7", None), (None, None, None)], "page_id long, url string, html string")
    other = pages.where("page_id IS NULL OR page_id <> 1234").withColumn("html", F.expr("if(page_id = 2222, 'rot', html)")).unionByName(spark.createDataFrame([(9000, "new", "y")], "page_id long, url string, html string"))
    a, b = fixity.tree(fixity.warc_records(pages)), fixity.tree(fixity.warc_records(other))
    assert sorted((r.record, r.status) for r in fixity.audit(a, b).collect()) == [(1234, "missing"), (2222, "altered"), (9000, "extra")]
    assert fixity.audit(a, a).count() == 0
    assert len(a) == fixity.LEVELS + 1 and a[-1].count() == 1
    unnamed = spark.createDataFrame([(None, f"u{k}", "y" * k) for k in range(300)] + [(None, None, None)] * 2, "page_id long, url string, html string")
    c, d = (fixity.tree(fixity.warc_records(x)) for x in (unnamed, unnamed.withColumn("html", F.expr("if(url = 'u17', 'rot', html)"))))
    assert [(r.record, r.status) for r in fixity.audit(c, d).collect()] == [(None, "altered")] and c[3].count() > 100
    bare = spark.createDataFrame([(None, None, f"body {k}") for k in range(300)], "page_id long, url string, html string")
    e, f = (fixity.tree(fixity.warc_records(x)) for x in (bare, bare.withColumn("html", F.expr("if(html = 'body 7', 'rot', html)"))))
    assert sorted(r.status for r in fixity.audit(e, f).collect()) == ["extra", "missing"] and e[0].select("a").distinct().count() > 100
    none = fixity.tree(fixity.warc_records(empty(spark, "page_id long, url string, html string")))
    assert fixity.audit(none, none).count() == 0


@pytest.mark.parametrize("change", ["altered", "missing", "extra"])
def test_fixity_of_records_that_repeat_an_id(spark, change):
    """Whatever an altered record hashes to, it alone is reported, however large the archive of its equals."""
    schema = "page_id long, url string, html string"
    rows = [(5, "u", f"body {k} " * 200) for k in range(400)] + [(5, "u", "twin")] * 3 + [(k, f"u{k}", "x" * k) for k in range(6, 60)]
    for k in (0, 133, 399, 401):
        other = list(rows)
        if change == "altered":
            other[k] = (5, "u", f"rot {k}")
        elif change == "missing":
            del other[k]
        else:
            other.append(rows[k])
        a, b = (fixity.tree(fixity.warc_records(spark.createDataFrame(x, schema)), 1 << 14) for x in (rows, other))
        assert [(r.record, r.status) for r in fixity.audit(a, b).collect()] == [(5, change)]


# 2 --------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    lat = langid.lattice(langid.PIECES)
    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.ones(lat.size), 3).T)
    ids = {p: k for k, p in enumerate(lat.pieces)}

    def brute(word, lang):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, a = [], 0
            for k, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(word[a : k + 1])
                    a = k + 1
            if all(p in ids or len(p) == 1 for p in parts):
                total += math.exp(sum(logp[ids.get(p, lat.size - 1), lang] for p in parts))
        return math.log(total)

    words = ["haus", "the", "été", "ж", "学x", "lesenlesenlese"]
    got = lat.log_words(words, logp)
    for w, row in zip(words, got):
        assert np.allclose(row, [brute("▁" + w, k) for k in range(3)])
    # A word of any length is summed whole: by a plain forward pass, letter by letter.
    long = "".join(random.Random(2).choice("aehinrst学") for _ in range(3000))
    marked = "▁" + long
    alpha = [0.0] + [-math.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - int(lat.lengths.max())), end):
            piece = marked[start:end]
            if piece in ids or len(piece) == 1:
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + logp[ids.get(piece, lat.size - 1), 0])
    assert np.isclose(lat.log_words([long, "the"], logp)[0, 0], alpha[-1])
    uses = lat.expected(["the"], np.ones((1, 3)), logp)
    assert np.allclose(uses.T @ lat.lengths, 4)  # every segmentation covers the word and its mark


def test_language_of_held_out_and_odd_texts(spark, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    model = langid.train(big, seen=~langid.held_out(), per_language=60)
    out = langid.identify(big.where(langid.held_out()), model)
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count() > 0
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert got[1] == got[2] == got[7] == got[8] == ("und", 0.0) and got[3] == got[4] and 0 <= got[5][1] <= 1
    assert langid.identify(empty(spark), model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(empty(spark))).collect()} == {"und"}
    marks = spark.createDataFrame([(k, t) for k, t in enumerate(["½", "² ³", "Ⅷ", "x²", "½the½house½"])], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(marks, model).orderBy("doc_id").collect()] == [True, True, True, False, False]
    assert langid.words_of("½The½hoUse² ok_a1b") == ["the", "house", "ok", "a", "b"]
    # Rows without an id are learned from; what repeats counts once.
    unnamed = spark.createDataFrame([(None, "en", f"the house is here {k}") for k in range(30)] + [(None, "de", "das haus ist da")] * 90, "doc_id long, lang string, text string")
    found = langid.train(unnamed, per_language=20)
    assert found["langs"] == ["de", "en"]
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "das haus ist"), (2, "the house is")], "doc_id long, text string"), found).orderBy("doc_id").collect()] == ["de", "en"]


def test_language_query(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op2_language_id"](spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    known = {d.lang for d in docs.values() if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 5}
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[k].text or ""))
        assert r.lang_pred in known | {"und"}


# 3 --------------------------------------------------------------------------------------------

def test_viterbi_is_best_and_comes_back(spark, odd, texts):
    coder = spm.Codec()

    def brute(unit):
        score = [0.0] + [-math.inf] * len(unit)
        for b in range(1, len(unit) + 1):
            for a in range(max(0, b - 16), b):
                if unit[a:b] in coder.pieces:
                    score[b] = max(score[b], score[a] + coder.pieces[unit[a:b]][1])
            if unit[b - 1] not in coder.pieces:
                score[b] = max(score[b], score[b - 1] + coder.byte_score * len(unit[b - 1].encode()))
        return score[-1]

    by_id = {i: s for i, s in coder.pieces.values()}
    for unit in ("▁hello", "▁▁▁", "▁zxqé", "☃☃a", "▁" + "ab" * 40):
        got = sum(by_id.get(i, coder.byte_score) for i in coder.best(unit))
        assert math.isclose(got, brute(unit)), unit
    for _, t in texts[:60]:
        assert coder.decode(coder.encode(t)) == t
    rnd = random.Random(1)
    for _ in range(2000):
        t = "".join(rnd.choice("ab ▁\n\té日☃  ") for _ in range(rnd.randint(0, 12)))
        assert coder.decode(coder.encode(t)) == t
    rows = spm.decode(spm.encode(odd)).collect()
    assert len(rows) == len(ODD) and all(r.decoded == r.text for r in rows)
    assert all(r.round_trip for r in spm.encode_checked(odd).collect())
    assert spm.encode(empty(spark)).count() == 0


# 4 --------------------------------------------------------------------------------------------

def brute_hits(text, items):
    words = WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = WORDS.findall((t or "").translate(LOWER))
        for a in range(max(1, len(own) - 9) if own else 0):
            w = own[a : a + 10]
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_is_exact(spark, odd, docs, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "W5 w6"), (901, None), (902, ""), (903, LONG[:400]), (904, LONG[:400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs.where("doc_id < 60"), bench).collect()
    by_id = dict(texts)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(by_id[r.doc_id], items)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(odd.withColumn("n_hit", F.lit(1)), bench).collect())
    assert got == sorted((d or 0, *brute_hits(t, items)[:3]) for d, t, *_ in ODD)
    assert decontaminate.contamination(odd, empty(spark, "item_id long, text string")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns


def brute_matches(words, item, window=10):
    """(doc_start, item_start, n) of the matches that can be made no longer on either side."""
    out = set()
    for a, b in itertools.product(range(len(words)), range(len(item))):
        if words[a] == item[b] and not (a and b and words[a - 1] == item[b - 1]):
            n = next((k for k in range(min(len(words) - a, len(item) - b)) if words[a + k] != item[b + k]), min(len(words) - a, len(item) - b))
            if n >= min(window, len(item)):
                out.add((a, b, n))
    return out


def test_longest_matches_are_exact(spark):
    rnd = random.Random(6)
    make = lambda n: " ".join(rnd.choice("abc") for _ in range(n))  # noqa: E731  few words: many and overlapping matches
    texts = [make(rnd.randint(0, 120)) for _ in range(12)]
    items = [(k, make(rnd.choice([3, 9, 10, 11, 40]))) for k in range(10)]
    items += [(100, items[4][1]), (101, texts[3]), (102, "zz " + texts[5][:40])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words) for r in decontaminate.find_matches(docs, bench).collect())
    want = sorted((d, str(i), *m) for d, t in enumerate(texts) for i, x in items for m in brute_matches(t.split(), x.split()))
    assert got == want and want
    for r in decontaminate.contamination(docs, bench).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(texts[r.doc_id], items)
        assert r.longest == max((m[4] for m in want if m[0] == r.doc_id), default=0)
    ids = np.array([2, 1, 2, 1, 0, 2, 1, 0])
    array = decontaminate.suffix_array(ids, 4)
    assert [ids[p : p + 5].tolist() for p in array] == sorted(ids[p : p + 5].tolist() for p in array) or array.tolist() == [3, 6, 1, 2, 5, 0]


# 5 --------------------------------------------------------------------------------------------

def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for k in range(200):
        n = int(rng.integers(0, 1500))
        ids = rng.integers(0, 2**62, n).astype(np.uint64) >> rng.integers(0, 62, n).astype(np.uint64)
        ids = np.repeat(ids[:9], rng.integers(1, 300, len(ids[:9]))) if k % 3 == 0 else ids
        words, starts, escapes = tokenfile.pack(ids)
        assert (tokenfile.unpack(words, starts, escapes, len(ids)) == ids).all()


def test_token_file(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenfile.TOKENIZER)
    assert tokenfile.Encoder(tokenfile.TOKENIZER)(["a<|endoftext|>b"]) == [np.array([64, 50256, 65], dtype="<u4").tobytes()]
    out = f"{tmp_path}/ids"
    tokenfile.write_token_file(odd, out, shards=3, chunk_ids=1000)
    rows = sorted(tokenfile.read_token_file(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, *_ in ODD), key=lambda d: -1 if d is None else d)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    want = sorted(plain.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in ODD)
    assert sorted(list(r.ids) for r in rows) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    tokenfile.write_token_file(empty(spark), f"{tmp_path}/none")
    assert tokenfile.read_token_file(spark, f"{tmp_path}/none").count() == 0
    coder = tokenfile.Encoder(tokenfile.TOKENIZER)
    rnd = random.Random(4)
    some = ["".join(rnd.choice(["a", "b", " ", "z", "A", ".", "'s", "\n", "\t", "é", "1", "½", "ł", "_", "#", "<|endoftext|>", "\x1c", "\x85", "　"]) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    assert coder(some) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in some]


def test_token_column(monkeypatch):
    """A column gives the library's ids, and only units that aren't known are encoded, also when the memory is full."""
    from tokenizers import Tokenizer

    plain, coder, encoded = Tokenizer.from_file(tokenfile.TOKENIZER), tokenfile.Encoder(tokenfile.TOKENIZER), []
    encode = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda units: (encoded.extend(units), encode(units))[1])

    def same(texts):
        ids, sizes = coder.column(pa.array(texts, pa.string()))
        made = [x.tolist() for x in np.split(ids, np.cumsum(sizes))[: len(texts)]]
        return made == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    assert same([]) and same([""]) and same(["", "one two, two. one!", "", " two", "Über's ende\n one  two"])
    assert sorted(encoded) == sorted({"", "one", " two", ",", ".", " one", "!", "Über", "'s", " ende", "\n one", "  two"})
    rnd = random.Random(5)
    for signs in (["a", "B", " ", "  ", "\n", ",", "é", "'s"], ["a", " ", " ", "z.", "'", "\n", "\t", "é", "1", "½", "ł", "_", "<|endoftext|>", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\u180e", "\u200b", "\x00", "ſ", "😀", "e\u0301"]):
        some = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 20))) for _ in range(6000)]
        monkeypatch.setattr(tokenfile, "CACHE_UNITS", 800_000)
        assert same(some)
        monkeypatch.setattr(tokenfile, "CACHE_UNITS", 200)
        assert all(same(some[a : a + 300]) for a in range(0, 3000, 300))
    assert same(["known words stay"])
    encoded.clear()
    monkeypatch.setattr(tokenfile, "CACHE_UNITS", 3)
    assert same(["known words go"]) and encoded == [" go"] and len(coder.number) == 3
    batch = pa.record_batch([pa.array(range(5)), pa.array(range(5)), pa.array(["x" * 10, "", None, "y" * 30, "z"])], ["shard", "doc_id", "text"])
    monkeypatch.setattr(tokenfile, "GROUP_BYTES", 20)
    parts = list(tokenfile.groups(batch.set_column(2, "text", batch.column(2).fill_null(""))))
    assert [p.num_rows for p in parts] == [3, 2] and sum((p.column(1).to_pylist() for p in parts), []) == list(range(5))


# 6 --------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="x"><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>side</aside><article><h1>Head &amp; {0}</h1><p><b>One
 two<br><p>Three &lt;{0}&gt; &copy; <i>four</i></p><div class="ad">Buy {0}</div><form><p>Sign up</p></form><ul><li>item<li>next</ul></article>
<section class="comments"><p>reader {0}</p></section><footer>foot</footer></body></html>"""


def test_wrappers(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE.format(k)) for k in range(12)] + [(20, None, None), (21, "http://h1.org", ""), (22, "x", "no tags & < here"), (23, "http://cut.org/", PAGE.format(5)[:330]), (24, "http://deep.org/", "<div>" * 3000 + "deep"), (25, "http://long.org/", "<article>" + "<p>word</p>" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.main_text(pages.withColumn("text", F.lit("clash"))).collect()}
    for k in range(12):
        assert got[k] == f"Head & {k}\nOne two\nThree <{k}> © four\nitem\nnext"
    assert got[20] == got[21] == "" and got[22] == "no tags & < here" and got[24] == "deep" and got[25] == "\n".join(["word"] * 20000)
    assert got[23].startswith("Head & 5")
    table = "".join(f"<div><span>Site {{0}}</span></div>" for _ in range(1))
    plain = spark.createDataFrame([(k, "http://plain.org/", f"<body><div><span>Same line</span></div><p>Text {k}</p></body>") for k in range(6)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.main_text(plain).collect()} == {f"Text {k}" for k in range(6)} and table
    assert wrappers.main_text(empty(spark, "page_id long, url string, html string")).count() == 0
    a, b = (wrappers._items(wrappers.parse(x)) for x in ("<p>a</p><p>b</p><hr><i>x</i>", "<p>c</p><b>y</b><i>x</i>"))
    shape = [(i[0], i[1], i[2]) for i in wrappers.align(a, b)]
    assert shape[0] == ("p", 1, 2) and shape[-1] == ("i", 1, 1) and {("hr", 0, 1), ("b", 0, 1)} <= set(shape)


@pytest.mark.parametrize("n", [3, 19, 25, 60])
def test_articles_keep_what_all_of_them_say(spark, n):
    page = "<body><p>Site</p><article><h1>T{k}</h1><h2>Summary</h2><p>Text {k} of it</p></article><p>Site</p></body>"
    rows = spark.createDataFrame([(k, f"http://h.org/{k}", page.format(k=k)) for k in range(n)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(rows).collect()}
    assert got == {k: f"T{k}\nSummary\nText {k} of it" for k in range(n)}


def test_only_what_all_pages_have_is_constant(spark):
    def texts(pages):
        df = spark.createDataFrame([(k, "http://h.org/", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
        return {r.page_id: r.text for r in wrappers.main_text(df).collect()}

    # Items of one label: the last one's text is constant, the first one's is not; a further copy of the constant stays.
    got = texts([f"<h1>T</h1><p>Text {k}</p><hr><p>Copyright X</p>" for k in range(6)] + ["<h1>T</h1><p>Copyright X</p><hr><p>Copyright X</p>", None, ""])
    assert got == {**{k: f"Text {k}" for k in range(6)}, 6: "Copyright X", 7: "", 8: ""}
    # The same one level deeper.
    got = texts([f"<div><b>Text {k}</b></div><hr><div><b>Copyright X</b></div>" for k in range(6)])
    assert got == {k: f"Text {k}" for k in range(6)}
    # A list of links does not make another list of its label one.
    got = texts([f"<ul><li>Text {k}</li></ul><hr><ul><li><a href='/'>Home</a></li></ul>" for k in range(6)])
    assert got == {k: f"Text {k}" for k in range(6)}
    # What one page alone has, and what all but one have.
    got = texts([f"<h1>T</h1><p>Text {k}</p>" + ("<blockquote>Quoted</blockquote><h3>Alone</h3>" if k == 3 else "") + ("<h4>Most</h4>" if k else "") for k in range(7)])
    assert got == {k: f"Text {k}" + ("\nQuoted\nAlone" if k == 3 else "") + ("\nMost" if k else "") for k in range(7)}
    # Fewer pages than CONSTANT_PAGES, and copies within a page, which make no more pages.
    assert texts([f"<h1>T</h1><p>Text {k}</p>" for k in range(4)])[0] == "T\nText 0"
    assert texts([f"<p>Text {k}</p>" + ("<ul><li>x</li><li>x</li><li>x</li></ul>" if k < 3 else "") for k in range(6)])[0] == "Text 0\nx\nx\nx"
    # Sequences too wide to align.
    wide = "".join(f"<x{chr(97 + a)}{chr(97 + b)}>w</x{chr(97 + a)}{chr(97 + b)}>" for a in range(15) for b in range(15))
    got = texts([wide + f"<p>Text {k}</p>" + "<i></i>" * (k % 2) + ("<h3>Alone</h3>" if k == 3 else "") for k in range(6)])
    assert "Alone" in got[3] and all(f"Text {k}" in got[k] for k in range(6))


def test_common_subsequence(monkeypatch):
    rnd = random.Random(7)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + (x == y)))
            row = new
        return row[-1]

    for cells in (1 << 22, 12):
        monkeypatch.setattr(wrappers, "TABLE_CELLS", cells)
        for _ in range(300):
            a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 20))] for _ in range(2))
            got = wrappers.common(a, b)
            assert len(got) == brute(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    shape = [[x[0], x[1]] for x in wrappers.align([[f"x{k}", 1, 1, []] for k in range(210)], [[f"x{k}", 1, 1, []] for k in range(210) if k != 99])]
    assert [x for x in shape if x[1] == 0] == [["x99", 0]]


def test_wrappers_decide_whatever_the_partitioning(spark, monkeypatch):
    """Pages made of known parts: what the text must be is known from how they were made."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    line = lambda n=12: " ".join(word() for _ in range(rnd.randint(3, n)))
    rows, want, bare = [], {}, {}
    for host in range(4):
        shared = [line() for _ in range(3)]
        shell = "article" if host % 2 else "div class='story'"
        for k in range(40):
            blocks, parts = [], []
            for _ in range(rnd.randint(1, 9)):
                t = line(40)
                blocks.append(t)
                parts.append(rnd.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div><p>{}</p></div>"]).format(t))
            menu = "<ul>" + "".join(f"<li><a href='/'>{line(3)}</a></li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
            box = "<div class='r'>" + "".join(f"<a href='/'>{line(3)}</a> " for _ in range(3)) + "</div>"
            inner = f"<p class='s'>{shared[0]}</p>" + "".join(parts) + f"<p class='t'>{shared[1]}</p>"
            page = f"<html><body><nav>{menu}</nav><div class='x'>{shared[2]}</div>{menu}{box}<{shell}>{inner}</{shell.split()[0]}><div class='ad'>{line()}</div><footer>{line()}</footer></body></html>"
            rows.append((len(rows), f"http://h{host}.org/{k}", page))
            # What all pages say is template outside of articles, and article inside.
            said = [shared[0], *blocks, shared[1]] if host % 2 else blocks
            want[len(rows) - 1], bare[len(rows) - 1] = "\n".join(said), wrappers.extract(page, None)
    assert all((bare[k] != want[k]) == (k < 40 or 80 <= k < 120) for k in want)  # without the wrapper the shared lines stay
    monkeypatch.setattr(wrappers, "FAN", 7)
    for parts in (1, 3, 11):
        pages = spark.createDataFrame(rnd.sample(rows, len(rows)), "page_id long, url string, html string").repartition(parts)
        got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
        assert got == want
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in wrappers.main_text(pages).collect()} == want
    # Pages that are all alike have no constants: their text stays.
    same = spark.createDataFrame([(k, "http://s.org/", "<article><p>Same text</p></article>") for k in range(9)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.main_text(same).collect()} == {"Same text"}


def test_words_and_depth_hide_no_article():
    for shell in (
        '<body class="has-sidebar"><p>Real</p></body>', '<body class="sidebar"><p>Real</p></body>', '<html class="search"><body id="comments"><p>Real</p></body></html>',
        '<div class="no-sidebar content"><p>Real</p></div>', '<article class="post comments-open"><p>Real</p></article>', '<article class="comments"><p>Real</p></article>',
        '<main role="search"><p>Real</p></main>', '<article><h2 class="section-header">Real</h2></article>', '<article><div class="search-results">Real</div></article>',
        '<article><header class="entry-header"><h1>Real</h1></header></article>',
    ):
        assert wrappers.extract(shell, None) == "Real", shell
    for hidden in ('<div class="cookie-notice">x</div>', '<div class="x ad">x</div>', '<div id="comments-list">x</div>', '<div class="site-footer">x</div>', '<div role="navigation">x</div>'):
        assert wrappers.extract(f"<body><p>Real</p>{hidden}</body>", None) == "Real", hidden
    deep = "<div>" * 150 + "deep" + "</div>" * 150
    assert wrappers.extract(f"<body><div><article><p>One</p>{deep}<p>Two</p></article></div><p>after</p></body>", None) == "One\ndeep\nTwo"
    for n in (98, 99, 100, 150):
        assert wrappers.extract("<div>" * n + "<nav><p>menu</p></nav><p>Real</p>" + "</div>" * n, None) == "Real"
    assert wrappers.extract("<p>One</p><!-- x --!><p>Two</p>", None) == "One\nTwo"
    assert wrappers.extract("<div>" * 150 + "<nav><p>menu</p></nav><article><p>Real</p><nav>x<p>y</p></nav><div>more</div></article>" + "</div>" * 150 + "<p>after</p>", None).split() == ["Real", "more"]
    assert wrappers.extract("<div>" * 150000 + "</x>" * 150000 + "<p>end" + "<b>" * 50000 + "<li></li>" * 5000, None) == "end"


# 7 --------------------------------------------------------------------------------------------

def brute_fingerprint(text, n=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(ids[k])
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))]


def test_simhash_components(spark, odd, docs, texts):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids, fps = [d for d, _ in texts], [brute_fingerprint(t) for _, t in texts]
    assert [got[d][0] % (1 << 64) for d in ids] == fps
    assert [got[d][1] for d in ids] == brute_components(ids, fps)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.fp == 0} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id IN (2, 4, 7)").count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_deduplicate_keeps_one_row_of_each_component(spark, odd):
    parts = {}
    for d, t, *_ in ODD:
        parts.setdefault(0 if not (t or "").split() else brute_fingerprint(t), []).append((d, t))
    parts[brute_fingerprint(LONG)] += parts.pop(brute_fingerprint(LONG + " tail"), []) if brute_fingerprint(LONG + " tail") != brute_fingerprint(LONG) else []
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(odd).collect()), key=str)
    assert len(got) == len(parts) and got.count((6, "same id")) == 1 and [t for d, t in got if d == 5] == [LONG]
    more = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z"), (4, "x y z"), (4, "x y z"), (9, "x y z")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate(more.repartition(3)).collect()), key=str) == [(4, "x y z"), (None, "a b c d")]
    assert simhash.deduplicate(empty(spark)).count() == 0


def brute_sketch(text, n=5):
    """The bits of a wide fingerprint as one number, and its keys."""
    import xxhash

    full = (1 << 64) - 1

    def mix(h, f):
        h = h * f & full
        h = (h ^ h >> 29) * f & full
        return h ^ h >> 32

    def odd_numbers(kind, k):
        return [xxhash.xxh64_intdigest(f"{kind}{i}") | 1 for i in range(k)]

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))] if words else []
    bits = 0
    for factor in [None, *odd_numbers("bits", 3)]:
        own = [mix(h, factor) if factor else h for h in hashes]
        bits = bits << 64 | sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    least = [min((h * f & full for h in hashes), default=0) for f in odd_numbers("order", 12)]
    return bits, {mix(mix(b + least[b] & full, 0x9E3779B97F4A7C15) + least[6 + b] & full, 0x9E3779B97F4A7C15) for b in range(6)} if hashes else {0}


def brute_similar(rows, radius):
    """The smallest id of each row's group."""
    made, root = [brute_sketch(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if made[a][1] & made[b][1] and (made[a][0] ^ made[b][0]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [rows[find(k)][0] for k in range(len(rows))]


def edited(words, n, rnd):
    """Words of which n, spread evenly, are replaced."""
    words = list(words)
    for k in range(n):
        words[k * len(words) // n + len(words) // (2 * n)] = f"new{rnd.random()}"
    return " ".join(words)


def test_similar_texts_go_and_others_stay(spark):
    rnd = random.Random(11)
    bases = [[f"v{rnd.randrange(5000)}" for _ in range(240)] for _ in range(80)]
    rows = [(k, " ".join(w)) for k, w in enumerate(bases)]
    rows += [(100 + k, edited(w, 3, rnd)) for k, w in enumerate(bases)]  # similarity 0.88
    rows += [(200 + k, edited(w, 24, rnd)) for k, w in enumerate(bases)]  # similarity 0.35
    rows += [(300 + k, edited(bases[0], 1, rnd)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.deduplicate_similar(docs.repartition(5)).collect())
    groups = brute_similar(rows, simhash.radius_of(0.8))
    assert kept == sorted(set(groups))
    assert set(range(80)) <= set(kept) and set(range(200, 280)) <= set(kept) and not any(k >= 300 for k in kept)
    assert sum(100 <= k < 200 for k in kept) <= 4
    # A shard over the limit is met piece by piece, with the same groups.
    nodes = simhash.sketches(docs, 5).select("fp", F.array(*[f"k{k}" for k in range(simhash.BANDS)]).alias("keys")).dropDuplicates(["fp"])
    whole, cut = (simhash.components(simhash.similar_links(nodes, simhash.radius_of(0.8), large)) for large in (1 << 18, 40))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_similar_on_odd_rows(spark, odd):
    kept = simhash.deduplicate_similar(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((r.doc_id, r.text) for r in simhash.deduplicate(odd, shingle=5).collect()), key=str)
    more = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z"), (4, "x y z"), (4, "x y z"), (9, "x y z"), (8, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate_similar(more.repartition(3)).collect()), key=str) == [(4, "x y z"), (8, None), (None, "a b c d")]
    assert simhash.deduplicate_similar(empty(spark)).count() == 0


def test_vantage_point_forest_loses_no_link(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12).astype(np.uint64)
    near = np.repeat(centres, 120)
    for _ in range(4):
        near ^= np.where(rng.random(len(near)) < 0.7, np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64), np.uint64(0))
    fps = np.unique(np.r_[near, rng.integers(0, 2**63, 800).astype(np.uint64)])
    want = brute_components(list(range(len(fps))), [int(f) for f in fps])
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for shard, large in ((1 << 15, 1 << 18), (100, 1 << 18), (100, 60)):
        root = {r.node: r.root for r in simhash.components(simhash.links(nodes, shard=shard, large=large)).collect()}
        label = [root.get(int(f), int(f)) for f in fps.view(np.int64)]
        first = {}
        assert [first.setdefault(x, k) for k, x in enumerate(label)] == want
    u, v, _ = simhash.search(fps, fps[:0])
    root = dict(zip(u.tolist(), v.tolist()))
    first = {}
    assert [first.setdefault(root.get(int(f), int(f)), k) for k, f in enumerate(fps)] == want


def test_vantage_point_trees_prune(spark):
    """On real fingerprints branches are pruned, in the tree over shards and inside of them."""
    nodes = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(4000).select("text")).distinct()
    fps = np.array([r.fp for r in nodes.collect()]).view(np.uint64)
    tree = simhash.Tree(fps[::4], 16)
    routed = list(tree.route(fps))
    rows = sum(len(i) for _, i, _ in routed)
    assert tree.shards == 16 and len(fps) < rows < 0.5 * tree.shards * len(fps)
    assert sorted(np.concatenate([i[home] for _, i, home in routed]).tolist()) == list(range(len(fps)))
    *_, state = simhash.search(fps, fps[:0])
    assert state.pruned > 0 and state.compared < 0.3 * len(fps) ** 2
    with_shards = simhash.components(simhash.links(nodes, shard=300)).count()
    assert with_shards == simhash.components(simhash.links(nodes)).count()


def test_fingerprints_of_single_words():
    import xxhash

    for text, shingle in (("One two\tthree two", 1), ("a b c d e", 2), ("a", 1), ("", 1)):
        words = text.lower().split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]), 42) for k in range(max(1, len(words) - shingle + 1))] if words else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text, shingle) == want


# 8 --------------------------------------------------------------------------------------------

def test_url_filter(spark):
    rows = [("http://A.example.ORG/en/12?x", "block", "example.org/en/1"), ("https://b.org/x", "allow", "org/"), ("https://b.org", "allow", None), ("http://x.com/de/", "block", "com/de/"), ("http://x.com/dex", "allow", None), (None, "allow", None), ("org/es/", "allow", None), ("http://example.org/es/1#a", "block", "example.org/es/"), ("http://notexample.org/es/", "allow", "org/")]
    df = spark.createDataFrame([(u, "clash") for u, *_ in rows], "url string, host string")
    assert [(r.url, r.verdict, r.rule) for r in urlfilter.judge(df.coalesce(1), urlfilter.RULES).collect()] == rows
    assert urlfilter.judge(empty(spark, "url string"), []).count() == 0


# 9 --------------------------------------------------------------------------------------------

def test_weighted_sampling_estimates_generalised_jaccard(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rnd.randint(0, 30)) for _ in range(600)) for _ in range(2)]
    mixes = [texts[0], texts[1], texts[0][:1500] + " " + texts[1][:1500], texts[0]]
    df = spark.createDataFrame(list(enumerate(mixes)), "k long, text string")
    weights = {r.k: dict(r.w) for r in df.select("k", F.explode(cws.terms("text")).alias("p")).groupBy("k", "p").agg(F.expr("sum(octet_length(p) + 1)").alias("n")).groupBy("k").agg(F.expr("collect_list(struct(p, n))").alias("w")).collect()}
    codes = {r.k: r.codes for r in cws.sketch(df, ["k"], samples=64).collect()}
    for a, b in itertools.combinations(range(4), 2):
        terms = weights[a].keys() | weights[b].keys()
        true = sum(min(weights[a].get(t, 0), weights[b].get(t, 0)) for t in terms) / sum(max(weights[a].get(t, 0), weights[b].get(t, 0)) for t in terms)
        got = sum(x == y for x, y in zip(codes[a], codes[b])) / 64
        assert abs(got - true) <= 3 * math.sqrt(true * (1 - true) / 64) + 0.01
    assert codes[0] == codes[3]


def exact_likeness(weights, a, b):
    x, y = weights[a], weights[b]
    terms = x.keys() | y.keys()
    return sum(min(x.get(t, 0), y.get(t, 0)) for t in terms) / sum(max(x.get(t, 0), y.get(t, 0)) for t in terms)


def test_fingerprints_of_all_documents(spark, docs, texts, odd):
    """n_chars, edited_sha256 and next document by brute force; likeness against the exact generalised Jaccard similarity."""
    whole = [t or "" for _, t in texts]
    edits = []
    for k, t in enumerate(whole):
        n, after = len(t) // 2, whole[(k + 1) % len(whole)]
        edits.append(t[: len(t) - n] + after[:n])
    rows = {r.doc_id: r for r in cws.with_fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    every = spark.createDataFrame([(t,) for t in sorted({*whole, *edits})], "text string")
    terms = every.select("text", F.explode(cws.terms("text")).alias("p")).groupBy("text", "p").agg(F.expr("sum(octet_length(p) + 1)").alias("n"))
    weights = {r.text: dict(r.w) for r in terms.groupBy("text").agg(F.expr("collect_list(struct(p, n))").alias("w")).collect()}
    off = []
    for k, (d, _) in enumerate(texts):
        r = rows[d]
        assert r.n_chars == len(whole[k]) and r.edited_sha256 == hashlib.sha256(edits[k].encode()).hexdigest()
        for got, other in ((r.near_edited, edits[k]), (r.near_next, whole[(k + 1) % len(whole)])):
            true = exact_likeness(weights, whole[k], other)
            # Codes of 16 bits agree by chance once in 65,536: one sample more, at most.
            assert abs(got - true) <= 4.5 * math.sqrt(true * (1 - true) / 64) + 1 / 64
            off.append(got - true)
    assert abs(sum(off)) / len(off) < 0.01


def test_next_document_in_many_ranges(spark, odd, docs, monkeypatch):
    monkeypatch.setattr(cws, "BUCKET_BYTES", 2000)
    rnd = random.Random(3)
    rows = [(rnd.choice([7, 7, 7, None, k]), f"text {rnd.randint(0, 300)}") for k in range(900)]  # ids that take up several ranges
    got = sorted(cws.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), key=lambda r: r.row)
    assert len({r.bucket for r in got}) > 5 and len(got) == len(rows)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and max(sum(r.bucket == b for r in got) for b in {r.bucket for r in got}) < 450
    assert [r.next_text for r in got] == [r.text for r in got[1:] + got[:1]]
    got = sorted(cws.with_next(docs).collect(), key=lambda r: r.row)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and [r.next_text for r in got] == [r.text for r in got[1:] + got[:1]]


def test_next_document_and_odd_rows(spark, odd):
    got = sorted((r for r in cws.with_next(odd).collect()), key=lambda r: r.row)
    assert len(got) == len(ODD) and [r.next_text for r in got] == [r.text for r in got[1:] + got[:1]]
    assert [r.next_row for r in got] == [r.row for r in got[1:] + got[:1]]
    out = registry.QUERIES["op9_fingerprints"](spark, SF)
    assert out.where("near_edited NOT BETWEEN 0 AND 1 OR near_next NOT BETWEEN 0 AND 1").count() == 0
    assert cws.with_next(empty(spark)).count() == 0 and cws.with_next(odd.where("doc_id = 1")).count() == 1


def test_texts_of_white_space_keep_their_rows(spark, odd):
    blank = [(20, "\n"), (21, " \t\n"), (22, "\r\n"), (23, " "), (24, "one two\n\n\n\n\n\n\n\n"), (25, "\n\n"), (25, "\n\n")]
    more = spark.createDataFrame(blank, "doc_id long, text string")
    assert all(list(r.t) == [""] for r in more.where("doc_id <> 24").select(cws.terms("text").alias("t")).collect())
    rows = cws.with_fingerprints(odd.unionByName(more, allowMissingColumns=True)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in rows) == sorted([-1 if d is None else d for d, *_ in ODD] + [d for d, _ in blank])
    assert all(v is not None for r in rows for v in (r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    alike = {r.fingerprint for r in rows if r.doc_id in (1, 2, 7, 20, 21, 22, 23, 25)}
    assert len(alike) == 1 and alike != {r.fingerprint for r in rows if r.doc_id == 24}


def test_neighbours_stay_the_same_however_often_tasks_run(spark, docs, monkeypatch):
    """Cuts are written once: the plan of the texts reads the documents once and takes no percentile, and runs again with equal rows."""
    monkeypatch.setattr(cws, "BUCKET_BYTES", 20_000)
    found = cws.with_next(docs.repartition(5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "approx" not in plan
    pick = lambda df: sorted((r.bucket, r.row, r.next_row, r.doc_id) for r in df.select("bucket", "row", "next_row", "doc_id").collect())
    first = pick(found)
    assert len({r[0] for r in first}) > 3 and len(first) == docs.count()
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    assert pick(found.repartition(2)) == first
    spark.conf.set("spark.sql.shuffle.partitions", 4)


# 10 -------------------------------------------------------------------------------------------

def test_licences(spark, odd):
    rows = ["MIT License, see MIT-License", "Licensed under the Apache License, Version 2.0.", "GNU General\nPublic License v3 or later; cc by-sa 4.0", "submit license", None, "", "x " * 5000 + "CC BY"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(rows)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert len(licences.rules()) > 300
    for k, t in enumerate(rows):
        words = WORDS.findall((t or "").translate(LOWER))
        places = [(a, label) for phrase, label in licences.BASE for a in range(len(words)) if words[a : a + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1].labels == "apache,apache-2.0" and got[1].score == 1.0 and got[3].labels == got[4].labels == ""
    assert got[2].labels == "cc-by,cc-by-sa-4.0,gpl,gpl-3.0"
    assert licences.scan(odd).count() == len(ODD) and licences.scan(empty(spark)).count() == 0


LICENCE_TEXTS = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("Neither the name of the Foo Company nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0"),
    ("GPLv3 code", "gpl-3.0"), ("LGPLv2.1+", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"), ("MPLv2", "mpl-2.0"), ("Apache2", "apache-2.0"), ("gpl v2 or later", "gpl-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: MIT", "mit"),
    ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights", "cc0-1.0"),
    ("same terms as Perl itself", ""), ("released under the same terms as Perl itself.", "perl"),
    ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"), ("Licensed under the Business Source License 1.1", "busl-1.1"), ("gplus lgplot mitlicense", ""),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "isc"),
    ("All rights reserved. All rights reserved. no part of this book may be reproduced", "all-rights-reserved,proprietary"),
]


def brute_scan(text):
    """(labels, score) by every rule on every text, without gates: intervals of words, then suppression."""
    norm = " " + " ".join(WORDS.findall(text.translate(LOWER))) + " "
    found = [(norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" ") - 1, r) for r in licences.rules() for m in re.finditer(r["pattern"], norm)]

    def covered(x):
        return any(
            y is not x and not y[2]["base"] and y[0] <= x[0] and y[1] >= x[1] and y[2]["prio"] <= x[2]["prio"]
            and (y[:2] != x[:2] or (y[2]["prio"], y[2]["rank"]) < (x[2]["prio"], x[2]["rank"])) for y in found
        )

    stay = [x for x in found if x[2]["base"] or not covered(x)]
    return ",".join(sorted({x[2]["label"] for x in stay})), max((licences.SCORES[x[2]["prio"]] for x in stay), default=0.0)


def test_licence_rules_and_suppression(spark):
    rnd = random.Random(5)
    texts = [t for t, _ in LICENCE_TEXTS]
    mixed = [" ".join(rnd.sample(texts, 4)) for _ in range(60)] + ["MIT License " * 400]
    words = sorted({w for t in texts for w in t.split()})
    mixed += [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(60)]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts + mixed)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts + mixed)
    for r in rows:
        assert (r.labels, r.score) == brute_scan((texts + mixed)[r.doc_id]), (texts + mixed)[r.doc_id]
    got = {r.doc_id: r.labels for r in rows}
    assert [got[k] for k in range(len(texts))] == [x for _, x in LICENCE_TEXTS]


def test_every_text_that_a_rule_fits_passes_its_gates():
    known = licences.rules()
    assert len(known) > 500 and all(r["anchors"] and r["gates"] for r in known)
    tried = 0
    for r in known:
        # The shortest text of a pattern, without its optional parts and with the first alternatives, and the fullest.
        whole = r["pattern"].removeprefix("(?<= )").removesuffix("(?= )")
        for full in (0, 1):
            plain = whole
            for _ in range(9):
                plain = re.sub(r"\(\?![^()]*\)", "", plain)
                plain = re.sub(r"\(\?:([^()]*)\)([?*]|\{[^}]*\}\??)?", lambda m: "" if m[2] and m[2] in "?*" and not full else m[1].split("|")[-full], plain)
            plain = re.sub(r"\[([^]])([^]])?[^]]*\]", lambda m: m[2] or m[1] if full else m[1], plain)
            text = f" {re.sub('([a-z ])[?]', lambda m: m[1] * full, plain).replace(' + ', ' x ').replace('^+ ', 'x ')} "
            if re.search(r["pattern"], text):
                tried += 1
                assert all(any(g in text for g in gate) for gate in r["gates"]), (r["label"], text, r["gates"])
                assert set(r["anchors"]) & set(text.split()), (r["label"], text, r["anchors"])
    assert tried > 1.9 * len(known)


# pipeline -------------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, docs, texts):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in texts if re.search(r"[^\W\d_]", t or "")]
    parts = brute_similar(kept, simhash.radius_of(corpus_pipeline.SIMILARITY))
    kept = [(d, t) for (d, t), c in zip(kept, parts) if c == d]
    kept = [(d, t) for d, t in kept if not brute_hits(t, items)[4]]
    assert sorted(rows) == sorted(d for d, _ in kept) and all(r.round_trip for r in rows.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0, name


def test_stages_on_odd_rows(spark, odd):
    """Nulls, repeated rows, a very long text and columns with clashing names, stage by stage."""
    words = "the house and the garden are here for all of them to see again"
    more = [(None, words, "en", "a", 1), (None, words, "en", "a", 1), (30, words, "en", "a", 1), (31, "das haus und der garten sind da", "de", "a", 1), (32, None, "en", None, None)]
    docs = odd.unionByName(spark.createDataFrame(more, DOCS)).withColumns({"score": F.lit("mine"), "n_hit": F.lit(-1), "fp": F.lit("x"), "lang_pred": F.lit(None).cast("string")})
    told = corpus_pipeline.language(spark, docs, SF)
    assert told.columns == docs.columns and {r.score for r in told.collect()} == {"mine"}
    kept = {(r.doc_id, r.text) for r in told.collect()}
    assert all(t and any(c.isalpha() for c in t) for _, t in kept) and (30, words) in kept and (5, LONG) in kept
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert single.columns == docs.columns
    assert [r.doc_id for r in single.where(F.col("text") == words).collect()] == [30] and single.where("text = 'same id'").count() == 1
    clean = corpus_pipeline.contamination(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count() and {r.n_hit for r in clean.collect()} == {-1}
    done = corpus_pipeline.tokens(spark, docs, SF)
    assert done.count() == docs.count() and "text" not in done.columns and set(docs.columns) - {"text"} <= set(done.columns)
    assert all(r.round_trip for r in done.collect())
