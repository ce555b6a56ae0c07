"""The driver's tables seen as triplets, graphs and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.operators.graph import Graph
from tessergraph.operators.triplets import Triplets
from tessergraph.runtime import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who supplied what, with what outcome: one triplet per line item."""
    return supplied(table(spark, sf_dir, "lineitem"))


def supplied(li: DataFrame, *more: str) -> DataFrame:
    edge = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted").otherwise("pending")
    meta = F.create_map(F.lit("chunk_id"), F.col("l_orderkey").cast("string"))
    return li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("triplet_ord"), F.concat(F.lit("S"), "l_suppkey").alias("node_1"), edge.alias("edge"), F.concat(F.lit("P"), "l_partkey").alias("node_2"), meta.alias("metadata"), "l_orderkey", *more)


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in regions, customers and suppliers in nations."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node_1"), F.lit("in").alias("edge"), F.concat(F.lit("R"), "n_regionkey").alias("node_2"))
    customer = t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("node_1"), F.lit("lives in").alias("edge"), F.concat(F.lit("N"), "c_nationkey").alias("node_2"))
    supplier = t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node_1"), F.lit("based-in").alias("edge"), F.concat(F.lit("N"), "s_nationkey").alias("node_2"))
    return nation.unionByName(customer).unionByName(supplier)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words of all documents."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where("size(w) > 1")
    pair = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.struct(i.alias("i"), x.alias("a"), F.get("w", i + 1).alias("b")))
    rows = docs.select("doc_id", F.explode(pair).alias("p"))
    return rows.select((F.shiftleft(F.col("doc_id"), 24) + F.col("p.i")).alias("triplet_ord"), F.col("p.a").alias("node_1"), F.lit("next").alias("edge"), F.col("p.b").alias("node_2"), F.create_map(F.lit("chunk_id"), F.col("doc_id").cast("string")).alias("metadata"))


def graph(t: DataFrame, domain: str | None = None) -> Graph:
    """The graph of triplets; a column ``tag`` gives their domains."""
    return Graph.tagged(t, "tag", domain) if "tag" in t.columns else Graph.build(Triplets(t), domain=domain)


def segmented_supply(spark: SparkSession, sf_dir: str, domain: str | None = None, stored: bool = False) -> Graph:
    """The supply graph tagged with the market segment of each order's customer; ``stored`` joins them once, for operators that read it several times."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_mktsegment").alias("tag"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag").join(orders, "l_orderkey")
    return graph(supplied(saved(li, "supply")[0] if stored else li, "tag"), domain)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
