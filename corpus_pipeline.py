"""Language ID, toxicity, exact and near deduplication and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run()
writes what a stage returns as Parquet in the shared folder and reads it back. All
stages but the last return the columns of ``documents``.

Nulls: a null text has no language and goes in the first stage. A null doc_id or lang is
carried along. Repeated rows: one stays. Ties: of equal texts the longest original, then the smallest doc_id
stays, of a near group the smallest doc_id. An empty table gives an empty result. Very long texts are read
whole by every stage. Columns of any other name stay as they are, as helper columns get names that the table doesn't have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import exact_dedup, language_id, minhash_dedup, packing, queries, toxicity
from docweft.llm.keys import fresh
from docweft.llm.workspace import Workspace
from docweft.sources.shared import spread


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; ``und`` (null, or no letter) goes. Where no lang is given at all, those with a letter stay."""
    prototypes = language_id.fit(docs)
    if not prototypes:
        return docs.filter(language_id.has_letter(F.col("text")))
    (guess,) = fresh(docs, "guess")
    return docs.withColumn(guess, language_id.predict(F.col("text"), prototypes)).filter(F.col(f"{guess}.lang") != language_id.UND).drop(guess)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score reaches the threshold of their language; network and thresholds are learned from all labelled documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True)
    (score,) = fresh(docs, "score")
    scored = docs.withColumn(score, toxicity.score(F.col("text"), model))
    return scored.filter(F.col(score) < toxicity.threshold(F.col("lang"), model)).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a similarity of 0.8 on five-word shingles."""
    return minhash_dedup.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    return packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The first stages learn from the corpus, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
