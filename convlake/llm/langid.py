"""Language identification with segmentation-marginalised unigrams.

The vocabulary is fixed and public: the letter pieces of a published SentencePiece model. For every
language the model holds one probability per piece; a word's probability is the sum over all its
segmentations into pieces (forward algorithm, in log space), a text's the product over its words.
Piece probabilities come from expectation-maximisation over the same segmentations.

Words are the runs of letters of the lower-cased text, so no piece crosses a word, and the sum over
all segmentations of a text is the product of the words' sums. A word is summed whole, however long.

Edge cases: null text, empty text or text without letters gives `und` with score 0 (numbers such as
fractions and Roman numerals are no letters); a table without labelled rows gives `und` for every
row; rows with null lang are never learned from, and those with null doc_id are held out by `held_out`; rows that repeat a
doc_id and text are learned from once; equal scores
go to the first language in alphabetical order; repeated rows are scored one by one; columns other
than those named are passed through `identify` untouched.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.llm.common import doc_key, materialise

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = re.compile(r"[^\W\d_]+")  # and numbers that are no digits
SAMPLE_PER_LANGUAGE = 200
ROUNDS = 2
CACHE_LETTERS = 8_000_000
GROUP = 512
BLOCK_LETTERS = 100_000


class Lattice:
    """All pieces of the vocabulary inside words, and sums over the paths that they form."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = set()
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).lower()
                if LETTERS.fullmatch(piece.removeprefix("▁")):
                    pieces.add(piece)
        pieces.add("▁")
        self.pieces = sorted(pieces)
        self.size = len(self.pieces) + 1  # the last id stands for any letter without a piece
        self.single = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in self.pieces] + [1], dtype=np.int64)

    def edges(self, words: list[str]):
        """(word, start, end, piece) of every edge, by end and then word."""
        pairs, owner = [], []
        find, single, unknown = self.automaton.iter, self.single, self.size - 1
        for word in words:
            before = len(pairs)
            pairs.extend(find(word))
            if not single.issuperset(word):
                pairs += [(end, unknown) for end, letter in enumerate(word) if letter not in single]
            owner.append(len(pairs) - before)
        flat = np.fromiter(chain.from_iterable(pairs), dtype=np.int64, count=2 * len(pairs))
        ends, ids = flat[::2].astype(np.int32), flat[1::2]
        owner = np.repeat(np.arange(len(words)), owner)
        order = np.argsort(ends, kind="stable")
        ends, ids, owner = ends[order].astype(np.int64) + 1, ids[order], owner[order]
        return owner, ends - self.lengths[ids], ends, ids

    def forward(self, words: list[str], logp: np.ndarray) -> tuple[np.ndarray, tuple]:
        """alpha[word, position, language]: log of the sum over all segmentations of the prefix."""
        owner, starts, ends, ids = edges = self.edges(words)
        alpha = np.full((len(words), max(map(len, words)) + 1, logp.shape[1]), -np.inf)
        alpha[:, 0] = 0
        bounds = np.searchsorted(ends, np.arange(alpha.shape[1] + 1))
        for end in range(1, alpha.shape[1]):
            part = slice(bounds[end], bounds[end + 1])
            w = owner[part]
            if len(w):
                rows, total = _log_sums(w, alpha[w, starts[part]] + logp[ids[part]])
                alpha[rows, end] = total
        return alpha, edges

    def log_words(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log probability of each word (letters only) in each language."""
        out = np.empty((len(words), logp.shape[1]))
        for index in _blocks(words):
            block = ["▁" + words[i] for i in index]
            alpha, _ = self.forward(block, logp)
            out[index] = alpha[np.arange(len(block)), [len(w) for w in block]]
        return out

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language over all segmentations of counted words."""
        out = np.zeros((self.size, logp.shape[1]))
        for index in _blocks(words):
            block = ["▁" + words[i] for i in index]
            alpha, (owner, starts, ends, ids) = self.forward(block, logp)
            sizes = np.array([len(w) for w in block])
            beta = np.full(alpha.shape, -np.inf)
            beta[np.arange(len(block)), sizes] = 0
            order = np.lexsort((owner, starts))
            bounds = np.searchsorted(starts[order], np.arange(alpha.shape[1] + 1))
            for start in range(alpha.shape[1] - 1, -1, -1):
                part = order[bounds[start] : bounds[start + 1]]
                if len(part):
                    w = owner[part]
                    rows, total = _log_sums(w, beta[w, ends[part]] + logp[ids[part]])
                    beta[rows, start] = np.logaddexp(beta[rows, start], total)
            whole = alpha[np.arange(len(block)), sizes]
            share = np.exp(alpha[owner, starts] + logp[ids] + beta[owner, ends] - whole[owner])
            share *= counts[index][owner]
            for lang in range(out.shape[1]):
                out[:, lang] += np.bincount(ids, share[:, lang], self.size)
        return out


def _blocks(words: list[str]):
    """Indices of words of like length, with BLOCK_LETTERS places of a lattice in all, or one word that has more."""
    index: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if index and (len(index) + 1) * (len(words[i]) + 2) > BLOCK_LETTERS:
            yield index
            index = []
        index.append(i)
    if index:
        yield index


def _log_sums(groups: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of the sorted groups, and log(sum(exp(x))) over each."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    most = np.maximum.reduceat(x, first, axis=0)
    size = np.diff(np.r_[first, len(groups)])
    return groups[first], most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, size, axis=0)), first, axis=0))


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def words_of(text: str | None) -> list[str]:
    """The runs of letters of the lower-cased text."""
    words = LETTERS.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():
        words = ["".join(run) for w in words for letters, run in groupby(w, str.isalpha) if letters]
    return words


def train(docs: DataFrame, path: str = PIECES, per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS, seen: "F.Column | None" = None) -> dict:
    """Fit piece probabilities on at most per_language labelled documents of each language.

    The sample is the documents whose hash of id and text is smallest; `seen` restricts what may be
    learned from. What comes to the driver is one number per piece and language.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.where(seen) if seen is not None else known
    known = known.select("lang", F.xxhash64(doc_key(), "text").alias("_h"), "text")
    ranked = known.select("lang", "_h").distinct().withColumn("_r", F.expr("row_number() OVER (PARTITION BY lang ORDER BY _h)"))
    chosen = ranked.where(F.col("_r") <= per_language).select("lang", "_h")
    sample = known.join(F.broadcast(chosen), ["lang", "_h"], "left_semi").dropDuplicates(["lang", "_h"])

    def split(batches):
        for batch in batches:
            langs, words = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = words_of(text)
                words += own
                langs += [lang] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    counts = sample.select("lang", "text").mapInArrow(split, "lang string, word string").groupBy("lang", "word").count()
    counted = materialise(counts.repartition(spark.sparkContext.defaultParallelism), "langid-words")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not langs:
        return {"langs": [], "logp": None, "path": path}
    size = lattice(path).size
    logp = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logp)

        def expect(batches, sent=sent):
            for batch in batches:
                if not batch.num_rows:
                    continue
                words = batch.column("word").to_pylist()
                counts = np.zeros((len(words), len(langs)))
                at = [langs.index(x) for x in batch.column("lang").to_pylist()]
                counts[np.arange(len(words)), at] = batch.column("count").to_numpy(zero_copy_only=False)
                uses = lattice(path).expected(words, counts, sent.value)
                piece, lang = np.nonzero(uses > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(uses[piece, lang])], ["piece", "lang", "uses"])

        uses = np.zeros((size, len(langs)))
        summed = counted.mapInArrow(expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        for piece, lang, n in summed.collect():  # at most pieces x languages
            uses[piece, lang] = n
        uses += 0.05
        logp = np.log(uses / uses.sum(axis=0))
    return {"langs": langs, "logp": logp, "path": path}


class Scorer:
    """Posterior over the languages of whole texts; words' sums are remembered."""

    def __init__(self, model: dict):
        self.langs, self.logp, self.path = model["langs"], model["logp"], model["path"]
        self.ids: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.langs)))
        self.letters = 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        self.letters += sum(map(len, new))
        if self.letters > CACHE_LETTERS:
            self.ids, new, self.letters = {}, list(words), sum(map(len, words))
        if new:
            size = len(self.ids) + len(new)
            if size > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty((size, len(self.langs)))])
            self.rows[len(self.ids) : size] = lattice(self.path).log_words(new, self.logp)
            self.ids.update(zip(new, range(len(self.ids), size)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows = [words_of(t) if self.langs else [] for t in texts]
        self.learn(set().union(*rows))
        names, scores, at = [], [], self.ids.__getitem__
        for words in rows:
            if not words:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.rows[np.fromiter(map(at, words), dtype=np.int64, count=len(words))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


@lru_cache(maxsize=1)
def scorer(key: str) -> list:
    """A worker's place for the scorer of one model, kept for the tasks that follow."""
    return []


def identify(docs: DataFrame, model: dict, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its posterior probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (lang_pred, score)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    key = uuid.uuid4().hex

    def run(batches):
        held = scorer(key)
        if not held:
            held.append(Scorer(sent.value))
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                names, scores = held[0](part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, lang_pred, score])

    return docs.select(*keep).mapInArrow(run, schema)


def held_out() -> "F.Column":
    return F.crc32(doc_key().cast("binary")) % 5 == 0


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, seen=~held_out())
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
