"""Search and retrieval: substring search, passages, BM25 (Q)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.ordered import in_order

WINDOW, STEP = 12, 6
MOST_HITS = 200  # of a search

# Words that questions and passages are searched without.
STOP_WORDS = """a an the and or but if of to in on at for with from by is are was were be been being it this that
these those i you he she we they me him her us them my your our their do does did so not no yes just
about what which who whom when where why how can could would should will shall may might must have has
had there here than then too very also as into over under up down out""".split()


def question_terms(question: str) -> list[str]:
    """The terms of a question; `summary` where nothing is left of it."""
    words = [w for w in re.findall(r"[\w']+", question.lower()) if len(w) > 1 and w not in STOP_WORDS]
    return words or ["summary"]


def search_like(segments: DataFrame, q: str, most: int = 200) -> DataFrame:
    """Q5. Segments that hold the text, case aside; the first `most` in order."""
    return segments.where(F.contains(F.lower("text"), F.lit(q.lower()))).select("meeting_id", "idx").orderBy("meeting_id", "idx").limit(most)


def passages(lines: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Q7. Overlapping windows of lines: (meeting_id, window, first, last, text)."""
    ids = f"sequence(greatest(0L, (idx - {window} + {step}) div {step}), idx div {step})"
    rows = lines.withColumn("window", F.explode(F.expr(ids)))
    out = rows.groupBy("meeting_id", "window").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.expr("array_sort(collect_list(struct(idx, line)))").alias("l"))
    return out.selectExpr("meeting_id", "window", "first", "last", "array_join(transform(l, x -> x.line), '\\n') AS text")


def bm25(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Q8. Score of every (meeting_id, window) for the terms, repeats counted; statistics are those of its meeting."""
    weight = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), F.lit(terms.count(t)))])
    docs = texts.select("meeting_id", "window", F.expr("filter(regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}_\\']+)', 1), w -> length(w) > 1)").alias("tokens"))
    docs = docs.withColumn("tokens", F.filter("tokens", lambda w: ~w.isin(STOP_WORDS)))
    docs = docs.select("meeting_id", "window", F.size("tokens").cast("double").alias("len"), F.explode_outer(F.filter("tokens", lambda w: w.isin(terms))).alias("term"))
    counts = docs.groupBy("meeting_id", "window", "len", "term").agg(F.count("term").alias("tf"))
    about = counts.select("meeting_id", "window", "len").distinct().groupBy("meeting_id").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = counts.where("tf > 0").groupBy("meeting_id", "term").agg(F.count("*").alias("df"))
    hits = counts.where("tf > 0").join(df, ["meeting_id", "term"]).join(about, "meeting_id").withColumn("times", weight[F.col("term")])
    score = "times * ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * len / greatest(avg, 1D)))"
    return hits.groupBy("meeting_id", "window").agg(F.sum(F.expr(score)).alias("score"))


def recent_chat(chat: DataFrame, most: int = 8) -> DataFrame:
    """Q11. The last `most` messages (meeting_id, id) of each meeting, numbered from 1 for the oldest of them."""
    rows = chat.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id ORDER BY id DESC) AS back").where(f"back <= {most}")
    return rows.withColumn("n", F.expr("cast(row_number() OVER (PARTITION BY meeting_id ORDER BY back DESC) AS bigint)")).drop("back")


def fold(text: str) -> Column:
    """Lower case without accents."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))

    return plain(text)


def token_lists(segments: DataFrame) -> DataFrame:
    """Segments (meeting_id, idx) with their folded words in order; none for a null text."""
    rows = segments.select("meeting_id", "idx", fold("text").alias("folded"))
    return rows.selectExpr("meeting_id", "idx", "coalesce(regexp_extract_all(folded, '[\\\\p{L}\\\\p{N}]+', 0), array()) AS tokens")


def build_index(segments: DataFrame) -> DataFrame:
    """Q1. Postings (token, meeting_id, idx, len, places): where in a segment of `len` words a folded word stands. Written
    in order of token, a search reads only the row groups that its prefixes fall into."""
    rows = token_lists(segments).select("meeting_id", "idx", F.expr("size(tokens)").cast("long").alias("len"), F.posexplode("tokens").alias("place", "token"))
    return rows.groupBy("token", "meeting_id", "idx", "len").agg(F.expr("array_sort(collect_list(cast(place AS bigint)))").alias("places"))


def index_statistics(segments: DataFrame) -> DataFrame:
    """Q1. What a search must know of all segments: one row of their number, those without words too, and of their words. Kept beside the
    postings, so that no search counts again."""
    return token_lists(segments).groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("words"))


def query_terms(q: str) -> list[list[str]]:
    """The terms of a query: each the folded words that must stand side by side (several only around ' and _)."""
    plain = "".join(c for c in unicodedata.normalize("NFD", q.lower()) if not unicodedata.combining(c))
    found = [re.findall(r"[^\W_]+", t) for t in re.findall(r"[\w']+", plain)]
    return [t for t in found if t]


def search_index(postings: DataFrame, statistics: DataFrame, q: str, most: int = MOST_HITS) -> DataFrame:
    """Q2. The best segments (meeting_id, idx, score) that hold every term; the last word of a term matches as a prefix.
    BM25 (k1 1.2, b 0.75) over all segments; its idf is at least a millionth. Ties in order of meeting and segment.
    Statistics are those of index_statistics; of the postings only the tokens of the query are read, once. An empty query finds nothing."""
    terms = query_terms(q)
    parts = [(k, j, w, j == len(t) - 1) for k, t in enumerate(terms) for j, w in enumerate(t)]
    if not parts:
        return postings.sparkSession.createDataFrame([], f"meeting_id {postings.schema['meeting_id'].dataType.simpleString()}, idx bigint, score double")
    wanted = reduce(or_, [F.col("token").startswith(w) if last else F.col("token") == w for _, _, w, last in parts])
    rows = postings.where(wanted)
    met = F.array(*[F.when(F.col("token").startswith(w) if last else F.col("token") == w, F.struct(F.lit(k).alias("term"), F.lit(j).alias("part"), F.lit(len(terms[k])).alias("of"))) for k, j, w, last in parts])
    rows = rows.select("meeting_id", "idx", "len", "places", F.explode(F.filter(met, lambda x: x.isNotNull())).alias("p")).select("meeting_id", "idx", "len", "p.*", F.explode("places").alias("place"))
    whole = rows.groupBy("meeting_id", "idx", "len", "term", "of", (F.col("place") - F.col("part")).alias("at")).agg(F.countDistinct("part").alias("n")).where("n = of")
    tf = whole.groupBy("meeting_id", "idx", "len", "term").agg(F.count("*").alias("tf"))
    # The terms of a segment as one row: those that lack one go before anything is counted of them.
    held = tf.groupBy("meeting_id", "idx", "len").agg(F.expr("collect_list(struct(term, tf))").alias("terms"))
    df = F.map_from_entries(F.collect_list(F.struct("term", "df")))
    known = tf.groupBy("term").agg(F.count("*").alias("df")).groupBy().agg(df.alias("dfs"))  # one row, an entry per term
    scored = held.where(F.size("terms") == len(terms)).join(F.broadcast(known)).join(F.broadcast(statistics.limit(1)))
    scored = scored.select("meeting_id", "idx", "len", "n", "words", "dfs", F.explode("terms").alias("t")).selectExpr("meeting_id", "idx", "len", "n", "words", "dfs[t.term] AS df", "t.tf AS tf")
    score = "greatest(ln((n - df + 0.5D) / (df + 0.5D)), 0.000001D) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * len * n / words))"
    out = scored.groupBy("meeting_id", "idx").agg(F.sum(F.expr(score)).alias("score"))
    return out.select("meeting_id", "idx", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "meeting_id", "idx").limit(most)


def snippets(hits: DataFrame, segments: DataFrame, q: str, width: int = 14) -> DataFrame:
    """Q3. Hits with a snippet: the first stretch of `width` words of the segment with most hits, hits as [[word]], and an
    ellipsis where words are left out."""
    firsts = F.array(*[F.lit(t[-1]) for t in query_terms(q)] or [F.lit("")]).alias("firsts")
    rows = segments.join(F.broadcast(hits.limit(MOST_HITS)), ["meeting_id", "idx"]).withColumn("folded", fold("text")).select("*", firsts)
    rows = rows.selectExpr("*", "filter(split(text, '\\\\s+'), w -> w <> '') AS ws", "filter(split(folded, '\\\\s+'), w -> w <> '') AS fs")
    rows = rows.selectExpr("*", "transform(fs, w -> exists(regexp_extract_all(w, '[\\\\p{L}\\\\p{N}]+', 0), t -> exists(firsts, f -> startswith(t, f)))) AS marks")
    best = f"array_max(transform(sequence(0, greatest(0, size(ws) - {width})), a -> struct(size(filter(slice(marks, a + 1, {width}), m -> m)) AS n, -a AS back)))"
    rows = rows.selectExpr("*", f"-({best}).back AS a").selectExpr("*", f"slice(ws, a + 1, {width}) AS shown", f"slice(marks, a + 1, {width}) AS lit")
    text = "array_join(zip_with(shown, lit, (w, m) -> if(m, concat('[[', w, ']]'), w)), ' ')"
    return rows.selectExpr("meeting_id", "idx", "score", f"concat(if(a > 0, '…', ''), {text}, if(a + {width} < size(ws), '…', '')) AS snippet")


def group_hits(hits: DataFrame, meetings: DataFrame, most: int = 5) -> DataFrame:
    """Q4. Per meeting (id, title, date_s) its best hits in order, at most `most`, and its place by the best of them."""
    shown = hits.orderBy(F.desc("score"), "meeting_id", "idx").limit(MOST_HITS)
    ranked = shown.selectExpr("meeting_id", "idx", "row_number() OVER (ORDER BY score DESC, meeting_id, idx) AS rank")
    ranked = ranked.selectExpr("*", "row_number() OVER (PARTITION BY meeting_id ORDER BY rank) AS place").where(f"place <= {most}")
    found = ranked.groupBy("meeting_id").agg(F.min("rank").alias("rank"), F.expr("transform(array_sort(collect_list(struct(place, idx))), h -> h.idx)").alias("hits"))
    return meetings.withColumnRenamed("id", "meeting_id").join(F.broadcast(found), "meeting_id").selectExpr("meeting_id", "title", "date_s", "cast(row_number() OVER (ORDER BY rank) AS bigint) AS place", "hits")


def title_hits(meetings: DataFrame, q: str, hits: DataFrame) -> DataFrame:
    """Q6. Meetings (id, title) whose title holds the text, case aside, and that have no hit yet."""
    named = meetings.where(F.contains(F.lower("title"), F.lit(q.lower())))
    return named.join(hits.selectExpr("meeting_id AS id"), "id", "left_anti").select("id", "title")


def _greedy(budget: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    def pick(rows: Iterator[tuple]) -> Iterator[tuple]:
        used, picked = 0, set()  # a line costs 2 or more, so the budget bounds what is picked
        for meeting, _, score, lines in rows:
            if score <= 0 and picked:
                break
            new = [line for line in lines if line["idx"] not in picked]
            cost = sum(line["tokens"] for line in new)
            if used + cost <= budget:
                used += cost
                picked.update(line["idx"] for line in new)
        for _ in rows:
            pass
        for idx in sorted(picked):
            yield meeting, idx

    return pick


def select_context(scores: DataFrame, lines: DataFrame, budget: int, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Q9. Lines (meeting_id, idx) of each meeting's best passages under a budget of tokens: best first (the earlier on
    ties), lines in two passages paid once, passages that don't fit skipped; passages that score nothing only as long as
    nothing is picked. scores: meeting_id, window, score of passages with a term; lines: meeting_id, idx, line."""
    priced = lines.selectExpr("meeting_id", "idx", "cast(length(coalesce(line, '')) * 2 div 7 + 2 AS bigint) AS tokens")
    priced = priced.withColumn("window", F.explode(F.expr(f"sequence(greatest(0L, (idx - {window} + {step}) div {step}), idx div {step})")))
    held = priced.groupBy("meeting_id", "window").agg(F.expr("array_sort(collect_list(struct(idx, tokens)))").alias("lines"))
    rows = held.join(scores, ["meeting_id", "window"], "left").selectExpr("meeting_id", "window", "coalesce(score, 0D) AS score", "lines")
    kind = lines.schema["meeting_id"].dataType.simpleString()
    return in_order(rows, ["meeting_id"], [F.desc("score"), "window"], _greedy(budget), f"meeting_id {kind}, idx long")


def ask_context(lines: DataFrame, picked: DataFrame, budget: int) -> DataFrame:
    """Q10. What is sent with a question: all lines of a meeting if they fit the budget, else the picked ones with a gap
    between them; `whole` tells which."""
    size = lines.groupBy("meeting_id").agg(F.expr("sum(length(line) + 1) - 1").alias("chars"))
    rows = lines.join(size, "meeting_id").join(picked.withColumn("in", F.lit(True)), ["meeting_id", "idx"], "left").withColumn("whole", F.expr(f"chars * 2 div 7 <= {budget}"))
    kept = rows.where("whole OR in").groupBy("meeting_id", "whole").agg(F.expr("transform(array_sort(collect_list(struct(idx, line))), x -> x.line)").alias("l"))
    return kept.selectExpr("meeting_id", "whole", "array_join(l, if(whole, '\\n', '\\n...\\n')) AS context")


def context_budget(context: int, history_tokens: int, notes_chars: int) -> int:
    """Q10. Tokens left for the transcript: 1200 are for the answer, 700 for the instructions; at least 800."""
    return max(800, context - 1200 - history_tokens - int(notes_chars / 3.5) - 700)
