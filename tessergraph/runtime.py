"""Session helpers: tables in the shared folder that cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without it, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        found = tempfile.mkdtemp(prefix="tessergraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tg-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "round") -> tuple[DataFrame, str]:
    """df written to and read from the shared folder, and where."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, by count and an order-free hash."""
    from pyspark.sql import functions as F

    sign = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64(*d.columns))).first()
    return sign(a) == sign(b)
