"""Corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
stage's docs. All but the last return the columns of documents. The quality classifier learns from the labelled rows of the
original documents, as those that the rules have left hold one quality label only; the rules and the mix learn from their own input,
which holds both of their labels (toxic documents are of either quality).

Defined results of every stage: a null text counts as empty (the rules reject it, as it has too few words); a null id, lang or source
is kept as it is, and a row without an id has no label; repeated rows are judged alike, and one of them stays after the near-duplicate stage;
ties go to the smaller id, then the smaller hash of the text; an empty table gives no rows; further columns are carried
along, also those named like a column that an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import mixing, ngram_join, packing, quality_gam, quality_rules
from quillstone.llm.common import materialise

#: Shares of tokens that the mix aims at, as first written, before they were tuned on data; the toxic one is a ceiling, so a corpus below it stays as it is.
TARGETS = {"clean": 0.97, "toxic": 0.03}
CEILINGS = frozenset({"toxic"})


def _original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality_gam.keep_predicted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_on=_original(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers of copies that bring the domains' tokens to TARGETS; clean ones all stay, toxic ones are never copied."""
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, domain, CEILINGS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 ids."""
    return packing.best_fit_pack(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _original(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
