"""The training-data pipeline: documents through five stages, each written as Parquet and read again.

quality classifier -> quality rules -> near-duplicates -> benchmark decontamination -> packing.

All stages but the last return the rows they keep with all the columns of their input.  Rows with a null ``doc_id``
pass through every filter that judges a text on its own, and near-duplicate removal leaves them alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papersift.llm import decontaminate, near_dup, packing, quality, quality_rules
from papersift.llm.common import stored


#: Pairs that share this part (percent) of their 5-word shingles, or more, are duplicates.
NEAR_PERCENT = 80

#: Token pieces that a worker remembers: fewer than in a job of its own, as all stages run in the same executors.
REMEMBERED = 80_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, remembered=REMEMBERED).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: A trained classifier, a tokenizer and a latent space are not SQL; tests/llm checks the pipeline stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that every stage kept."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
