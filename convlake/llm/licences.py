"""Licence scans with ordered signature rules, in DataFrame expressions only.

A text is reduced to its words (A-Z lower-cased; runs of 0-9, a-z and what is beyond ASCII) with one
space between them. Rules are regular expressions over that form: signatures of notices and licence
texts written out one by one, and names of licences put into a few patterns (`licence_rules`). A rule
is tried only on texts that hold its keywords; these are looked for only if words that they have
stand in the text, which one pass over its words tells. Each match is an interval
of words with a priority: 1 a notice, 2 a name with its version, 3 a name. An interval that lies
inside one of the same or a better priority is suppressed; of equal intervals of the same priority the
first rule's stays.
The base phrases are rules of their own, counted at every place and never suppressed.

Edge cases: null and empty texts have no words, no places, empty labels and score 0; repeated rows
are judged one by one; a word that only looks like part of a phrase ("submit license") is no place;
ties between rules go to the first; extra columns pass through `scan` unless they have a name of its
results.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.licence_rules import BASE, rules  # noqa: F401

SCORES = {1: 1.0, 2: 0.9, 3: 0.7}


def words_form(text: str) -> "F.Column":
    """The words of a text column with a space before, between and after them; two spaces if there are none."""
    # Only the Kelvin sign becomes a letter of a-z by lower(), and İ an i with a dot above: neither makes or breaks a base phrase.
    return F.expr(rf"concat(' ', trim(regexp_replace(lower(coalesce({text}, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ')), ' ')")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [c for c in docs.columns if c not in (text, *made)]
    schema = "array<struct<rank:int,base:boolean,prio:int,label:string,anchors:array<string>,gates:array<array<string>>,pattern:string>>"
    known = rules()
    table = F.from_json(F.lit(json.dumps(known)), schema)
    words = F.from_json(F.lit(json.dumps(sorted({w for r in known for w in r["anchors"]}))), "array<string>")
    parts = "split(regexp_replace(norm, r.pattern, '\\u0001$0\\u0002'), '[\\u0001\\u0002]')"
    spaces = "length(p) - length(replace(p, ' ', ''))"
    hits = f"flatten(transform(filter(rules, r -> arrays_overlap(r.anchors, met) AND forall(r.gates, g -> exists(g, k -> contains(norm, k)))), r -> transform({parts}, (p, i) -> struct(r.rank AS rank, r.base AS base, r.prio AS prio, r.label AS label, i AS i, {spaces} AS spaces))))"
    rows = docs.select(F.struct(*keep).alias("doc") if keep else F.lit(None).alias("doc"), words_form(text).alias("norm")).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("n_words", F.expr("if(norm = '  ', 0L, length(norm) - length(replace(norm, ' ', '')) - 1L)"))
    gated = rows.withColumn("met", F.array_intersect(F.split("norm", " "), words)).withColumn("rules", F.when(F.size("met") > 0, table))
    rows = gated.select("rid", "doc", "n_words", F.explode_outer(F.expr(hits)).alias("x")).select("rid", "doc", "n_words", "x.*")
    rows = rows.repartition("rid")
    # A part at an odd place is a match; the words before it are the spaces before it less one.
    rows = rows.selectExpr("*", "i % 2 = 1 AS hit", "sum(spaces) OVER (PARTITION BY rid, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS start")
    rows = rows.selectExpr("*", "start + spaces AS until")
    before = "OVER (PARTITION BY rid ORDER BY start, until DESC, prio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = rows.selectExpr("*", *[f"max(if(hit AND NOT base AND prio <= {p}, until, NULL)) {before} AS over{p}" for p in SCORES])
    covered = "coalesce(element_at(array(over1, over2, over3), prio) >= until, false)"
    rows = rows.selectExpr("*", f"hit AND (base OR NOT {covered}) AS stays", "hit AND base AS placed")
    points = " ".join(f"WHEN {p} THEN {s}D" for p, s in SCORES.items())
    return (
        rows.groupBy("rid", "doc", "n_words")
        .agg(
            F.expr("count_if(placed)").alias("n_base"),
            F.expr("cast(min(if(placed, start, NULL)) AS bigint)").alias("first_word"),
            F.expr("cast(max(if(placed, start, NULL)) AS bigint)").alias("last_word"),
            F.expr("array_join(array_sort(collect_set(if(placed, label, NULL))), ',')").alias("base_labels"),
            F.expr("array_join(array_sort(collect_set(if(stays, label, NULL))), ',')").alias("labels"),
            F.expr(f"coalesce(max(if(stays, CASE prio {points} END, NULL)), 0D)").alias("score"),
        )
        .select(*[F.col("doc")[c].alias(c) for c in keep], *made)
    )


def op10_licences(spark, sf_dir: str) -> DataFrame:
    from convlake.llm.common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
