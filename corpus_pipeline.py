"""A corpus pipeline of four stages: language, near-duplicates, contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one works on what was
written of it.

Edge cases: a null or empty text, or one without letters, goes at the first stage; of repeated rows, with
or without an id, the second keeps one; long texts are read whole; empty tables pass through all stages;
extra columns pass through, but for `ids` and the other columns that `tokens` makes, and `text`, which it
leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm import decontaminate, langid, simhash, spm
from convlake.llm.common import materialise, table

LEAST_SCORE = 0.5
SHINGLE, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or with no likely language go."""
    model = langid.train(docs, seen=~langid.held_out())
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    judged = langid.identify(packed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return judged.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash of shingles of five words, linked at a similarity of 0.8 or more."""
    return simhash.deduplicate_similar(docs, SIMILARITY, SHINGLE)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return spm.encode_checked(docs).drop("text")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination), ("tokens", tokens)]

#: No SQL expresses the language model, the fingerprints or the best segmentation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
