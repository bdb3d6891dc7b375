"""From raw documents to packed token sequences: the stages of the corpus pipeline.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``. A stage judges
all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.mixing import mixed_documents
from cellweave.llm.packing import pack_documents, tokenizer_path
from cellweave.llm.quality import quality_rules
from cellweave.llm.simhash import drop_near_duplicates
from cellweave.llm.toxicity import drop_toxic
from cellweave.session import cut_lineage, ship_package


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not call toxic; its weights come from the labelled rows."""
    ship_package(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ship_package(spark)
    return quality_rules(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document comes once for every epoch that takes it."""
    ship_package(spark)
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    ship_package(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", keep_clean),
    ("quality rules", keep_good),
    ("simhash near-duplicates", keep_one_of_each_group),
    ("source mix", mix),
    ("best-fit packing", pack),
]
#: Learned weights, hashes and tokenizers are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is stored as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
