"""A corpus pipeline of five operators, each stage written and read again by whoever runs it.

Quality rules and toxicity drop what they reject, of near copies (five-word
shingles, Jaccard similarity 0.8 or more) one document stays, the secret scan redacts what it finds, and the last stage
packs the rest into training sequences, with the redacted text of each piece.
Empty tables pass through every stage; rows with null ids are treated as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessergraph.llm import common, neardup, packing, quality, secrets, simhash, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, neardup.classes)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(docs, carry=True)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the packing aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's output is written; what a stage stored on its way, and what the next one has read, is deleted."""
    docs, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.shared_path(spark, name.replace(" ", "-"))
        with common.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        if was:
            common.remove(spark, was)
        was = path
    return docs
