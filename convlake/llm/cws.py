"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A text's terms are phrases: its lower-cased words, cut behind every word whose hash is 0 modulo CUT,
so that an edit changes the phrases around it and no others. A term's weight is the bytes it takes
up in the text, all its places together. For each of SAMPLES samples a term draws, from its hash
alone, r and c from Gamma(2, 1) and b from Uniform(0, 1); with weight S, t = floor(ln S / r + b) and
ln a = ln c - r (t - b + 1). The sample is the (term, t) with the least a, and two texts' samples
collide with a probability equal to their generalised Jaccard similarity. A sample is kept as 16
bits of a hash of (term, t).

Every term is weighed, however many; minima are aggregated before they are shuffled.

Edge cases: a null text counts as empty, and a text without a phrase (empty, or white space alone)
has one term of its own, so such texts are alike; texts that share words but no phrase have likeness 0; equal texts have
equal fingerprints; repeated rows and ties in doc_id are ordered by a hash of the text; null doc_ids come first; one
document alone is its own next; extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import materialise

SAMPLES = 64
CUT = 6
BUCKET_BYTES = 8_000_000


def terms(text: str) -> "F.Column":
    """The phrases of a text column, in order."""
    marked = f"array_join(transform(split(lower({text}), '\\\\s+'), w -> if(pmod(xxhash64(w), {CUT}) = 0, concat(w, '\\n'), w)), ' ')"
    found = f"filter(split({marked}, '\\n ?'), p -> p <> '')"
    return F.expr(f"transform(array({found}), f -> if(size(f) = 0, array(''), f))[0]")


def _sample(k: int) -> str:
    """ln a in the upper bits, 16 bits of the sample's hash in the lower, of a term h with log weight s."""
    x, y = f"xxhash64(h, {2 * k})", f"xxhash64(h, {2 * k + 1})"

    def uniform(z: str, low: int) -> str:
        return f"((shiftrightunsigned({z}, {low}) & 2097151L) + 0.5D) * {2.0 ** -21!r}D"

    r = f"(-ln({uniform(x, 0)} * {uniform(x, 21)}))"
    ln_c = f"ln(-ln({uniform(x, 42)} * {uniform(y, 0)}))"
    b = uniform(y, 21)
    t = f"floor(s / {r} + {b})"
    ln_a = f"({ln_c} - {r} * ({t} - {b} + 1D))"
    code = f"((shiftrightunsigned({y}, 48) ^ {t}) & 65535L)"
    return f"(shiftleft(cast(({ln_a} + 512D) * {float(1 << 37)!r}D AS bigint), 16) | {code})"


def sketch(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and codes (array of the samples' 16-bit codes) of the texts; keys name a text."""
    rows = texts.select(*keys, F.explode(terms(text)).alias("p"))
    rows = rows.select(*keys, F.xxhash64("p").alias("h"), F.expr("octet_length(p) + 1L").alias("n"))
    weights = rows.groupBy(*keys, "h").agg(F.sum("n").alias("n")).select(*keys, "h", F.expr("ln(cast(n AS double))").alias("s"))
    least = weights.groupBy(*keys).agg(*[F.min(F.expr(_sample(k))).alias(f"m{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[(F.col(f"m{k}").bitwiseAND(F.lit(65535))).cast("int") for k in range(samples)]).alias("codes"))


def likeness(a: str, b: str) -> "F.Column":
    """The share of samples on which two fingerprints agree: an estimate of generalised Jaccard similarity."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x) / cast(size({a}) AS double)")


def as_hex(codes: str) -> "F.Column":
    return F.expr(f"lower(array_join(transform({codes}, x -> lpad(hex(x), 4, '0')), ''))")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, row, next_row, doc_id, text, next_text: each document with the next in ascending doc_id, the last with the first.

    Documents are dealt to ranges of doc_id of about BUCKET_BYTES of text, cut in two steps of about the square root of
    their number each; a doc_id that takes up several ranges is dealt over them by the hash of its texts. The first of
    each range is also sent to the range before it. What is broadcast is a number per range and the heads.
    """
    key = "coalesce(try_cast(doc_id AS bigint), -9223372036854775808L)"
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(key).alias("k")).withColumn("th", F.xxhash64("text"))
    # Cuts are taken from a thin table and written: a task that runs again deals its documents as before.
    thin = materialise(docs.select("k", "th", F.octet_length("text").alias("n")), "cws-keys")
    size = thin.agg(F.sum(F.col("n") + F.lit(64))).first()[0] or 0
    steps = math.isqrt(max(1, size // BUCKET_BYTES) - 1) + 1
    cuts = F.percentile_approx("k", [i / steps for i in range(1, steps)] or [0.5], 20 * steps) if steps > 1 else F.lit(None)
    cuts = F.coalesce(cuts.cast("array<bigint>"), F.expr("cast(array() AS array<bigint>)")).alias("cuts")
    # How many of the ranges behind k lie before it, and of those that end at k those that its texts' hash is past.
    place = "cast(size(filter(cuts, c -> c < k)) + floor((size(filter(cuts, c -> c = k)) + 1) * (shiftrightunsigned(th, 11) * {p})) AS int)".format(p=f"{2.0**-53!r}D")
    coarse = materialise(thin.agg(cuts), "cws-cuts")
    half = lambda rows: rows.join(F.broadcast(coarse)).withColumn("a", F.expr(place)).drop("cuts")
    inner = materialise(half(thin).groupBy("a").agg(cuts), "cws-cuts")  # at most `steps` rows of as many numbers
    whole = lambda rows: half(rows).join(F.broadcast(inner), "a").withColumn("home", F.expr(f"a * {steps} + {place}")).drop("cuts", "a")
    heads = whole(thin).groupBy("home").agg(F.min(F.struct("k", "th")).alias("head"))  # a row per range
    heads = materialise(heads.selectExpr("home", "head", "coalesce(lag(home) OVER (ORDER BY home), max(home) OVER ()) AS before"), "cws-heads")
    dealt = whole(docs)
    rows = dealt.join(F.broadcast(heads), "home")
    both = "array(struct(home AS bucket, false AS ghost), struct(before AS bucket, true AS ghost))"
    rows = rows.withColumn("to", F.explode(F.expr(f"if(k = head.k AND th = head.th, {both}, array(struct(home AS bucket, false AS ghost)))")))
    rows = rows.select("to.bucket", "to.ghost", "home", "k", "th", "doc_id", "text")
    over = "OVER (PARTITION BY bucket ORDER BY ghost, k, th)"
    rows = rows.selectExpr("*", f"shiftleft(cast(home AS bigint), 40) + if(ghost, 1, row_number() {over}) AS row")
    rows = rows.selectExpr("*", f"lead(text) {over} AS next_text", f"lead(row) {over} AS next_row")
    return rows.where("NOT ghost").select("bucket", "row", "next_row", "doc_id", "text", "next_text")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document, with its likeness to an edit of it, half of whose text is of
    the next document, and to the next document."""
    pairs = with_next(docs)
    edited = "concat(left(text, length(text) - length(text) div 2), left(next_text, length(text) div 2))"
    about = ["bucket", "row", "next_row", "doc_id", "n_chars", "edited_sha"]
    pairs = pairs.select("bucket", "row", "next_row", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", F.expr(edited).alias("edited"))
    pairs = pairs.withColumn("edited_sha", F.unhex(F.sha2("edited", 256)))
    both = pairs.select(*about, F.explode(F.expr("array(struct(0 AS v, text AS text), struct(1 AS v, edited AS text))")).alias("t")).select(*about, "t.v", "t.text")
    # All that follows keeps to the buckets the texts were dealt to: no text is shuffled again.
    codes = sketch(both, [*about, "v"])
    sides = codes.groupBy(*about).agg(F.expr("max(if(v = 0, codes, NULL))").alias("own"), F.expr("max(if(v = 1, codes, NULL))").alias("edit"))
    sides = materialise(sides.drop("bucket"), "cws")
    out = sides.join(sides.select(F.col("row").alias("next_row"), F.col("own").alias("next")), "next_row", "left")
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), as_hex("own").alias("fingerprint"), as_hex("edit").alias("edited_fingerprint"),
        likeness("own", "edit").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    return with_fingerprints(table(spark, sf_dir, "documents"))
