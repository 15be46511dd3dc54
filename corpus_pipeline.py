"""The corpus pipeline: five stages from raw documents to shuffled shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet to the shared
folder and rereads as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, mixing, quality, sharding
from quire.llm.common import Scratch, remainder, table

_held: list[Scratch] = []


def _scratch(spark: SparkSession, docs: DataFrame, name: str) -> Scratch:
    """A stage's folder for what it keeps until its rows are written. Each stage's `docs` are the rows written of the one before, so the
    folders of earlier stages go, unless `docs` still reads them."""
    read = docs.inputFiles()
    for old in [x for x in _held if not any(x.root.partition(":")[2].lstrip("/") in f for f in read)]:
        old.close()
        _held.remove(old)
    fresh = Scratch(spark, name)
    _held.append(fresh)
    return fresh


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shares of the expected tokens by domain; the good domain keeps the tokens that it has.
MIX = {"good": 0.98, "low": 0.01, "toxic": 0.01}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the same labelled rows as its query."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, labels, _scratch(spark, docs, "quality"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.75 or more stays: the one of smallest id."""
    return jaccard.one_of_each(docs, _scratch(spark, docs, "jaccard"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), _scratch(spark, docs, "leaks"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken at the rates that bring the domains' expected tokens to MIX; good ones keep a rate of about 1."""
    labels = mixing.by_quality_and_toxicity(table(spark, sf_dir, "labels"))
    return mixing.take(docs, labels, MIX, _scratch(spark, docs, "mix"), anchor="good")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents get a shard of 16 and a slot there, in random order."""
    return sharding.shard(docs, n_shards=16, scratch=_scratch(spark, docs, "shards"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained classifier, a mixture of posteriors and a seeded shuffle are beyond SQL: the tests hold the pipeline
#: against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table `documents`."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
