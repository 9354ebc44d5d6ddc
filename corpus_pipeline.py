"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, written as Parquet and read again; all but the last return the columns of
``documents``. Toxic documents go, then those of low quality, then all but one of each group of near-duplicates; secrets
are replaced by a mark, and what is left is packed into windows of tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableload.llm import jaccard, packing, quality, secrets, toxicity
from tableload.llm.rows import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, _labels(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _labels(spark, sf_dir))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id (null after all others), of these the smallest hash of its
    text, and of equal texts the smallest hash of the row. Rows without shingles are all kept.

    Every row is decided by its id and its text, so rows that share an id may fare differently.
    """
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text"))
    found = written(jaccard.near_duplicates(docs.select(row.alias("doc_id"), "text")), "near-duplicates")
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_row")).distinct()
    kept = docs.withColumn("_row", row).join(others, "_row", "left_anti")
    repeats = found.where("doc_id = component_id and n_shingles > 0").groupBy(F.col("doc_id").alias("_row")).count()
    repeats = written(repeats.where("count > 1").select("_row"), "repeated-rows")
    if repeats.limit(1).count():
        first = F.row_number().over(Window.partitionBy("_row").orderBy(F.xxhash64(*docs.columns)))
        one = kept.join(repeats, "_row", "left_semi").withColumn("_first", first).where("_first = 1").drop("_first")
        kept = kept.join(repeats, "_row", "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", keep_civil),
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
