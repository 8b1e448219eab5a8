"""From raw documents to shards: quality classifier, near-duplicates, decontamination, mixing, sharding.

What every stage does with odd rows: an empty table gives an empty one; a null
or empty text is a text without words; texts of any length are taken whole;
columns besides those of `documents` travel along, whatever their names (one
named like an output of the last stage is replaced).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import cotrain, decontam, minhash_join, pareto_mix, sharding
from siltstone.llm.common import Scratch


NAMES = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage with columns that documents don't have packed into one, so that no name of theirs meets one that an operator uses."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in NAMES]
        if not more:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*(c for c in docs.columns if c in NAMES), F.struct(*more).alias("carried")), sf_dir)
        new = [c for c in out.columns if c not in NAMES and c != "carried"]
        return out.select(*(c if c in NAMES else F.col("carried")[c].alias(c) for c in docs.columns if c not in new), *new)

    return run_stage


@carrying
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts: of good quality and not toxic.

    Each row is judged by itself: repeated rows stay or go together, and a row
    without id, language, source or text is scored by what it has. Labels of a
    null id or value take no part; without labels nothing goes."""
    scored = cotrain.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("kept").select(*docs.columns)


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles of Jaccard similarity 0.8 or more: that of the smallest id.

    Texts without words are linked with nothing and stay; rows of one id and
    text are kept once; a row without id stays where its set is no other's."""
    return minhash_join.one_of_each(docs, words=5, percent=80).select(*docs.columns)


@carrying
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of eight words of a benchmark item (of a shorter item: of all its words).

    A text without words has no window. Items without words or text contaminate
    nothing; repeated rows stay or go together, null ids too."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=8, mode="documents", least_items=1)


@carrying
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix of sources takes.

    Sources without any words get nothing, and a null source is one like
    others; a document without words isn't taken. Ties of odds go by id;
    repeated rows are taken each for itself."""
    return pareto_mix.copies(pareto_mix.mix(docs)).select(*docs.columns)


@carrying
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard (0 to 7) and slot, gapless from 0 in each shard; every row has a place of its own, repeated ones too."""
    return sharding.shard(docs, 8)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The classifier is fitted, which SQL can't express; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tmp = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = tmp.table(stage(spark, docs, sf_dir), f"{k}")
        if k:
            tmp.drop(f"{k - 1}")
    return docs
