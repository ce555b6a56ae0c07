"""Triplets: an ordered multiset of (node_1, edge, node_2, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessergraph.functions.cypher import triplet_text
from tessergraph.functions.ids import triplet_id
from tessergraph.schema import TRIPLET


class Triplets:
    """A DataFrame in the TRIPLET layout, its configuration and its item's record."""

    def __init__(self, df: DataFrame, config: dict | None = None, item: dict | None = None):
        missing = {"node_1", "edge", "node_2"} - set(df.columns)
        if missing:
            raise ValueError(f"triplets lack the columns {', '.join(sorted(missing))}")
        if "metadata" not in df.columns:
            df = df.withColumn("metadata", F.create_map().cast("map<string,string>"))
        if "triplet_ord" not in df.columns:
            df = df.withColumn("triplet_ord", F.monotonically_increasing_id())
        self.df = df.select("triplet_ord", "node_1", "edge", "node_2", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
        self.config, self.item = config or {}, item or {}

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple]) -> Triplets:
        """From (node_1, edge, node_2[, metadata]) tuples, in their order."""
        full = [(i, r[0], r[1], r[2], {k: str(v) for k, v in (r[3] if len(r) > 3 else {}).items()}) for i, r in enumerate(rows)]
        return cls(spark.createDataFrame(full, TRIPLET))

    def union(self, *others: Triplets) -> Triplets:
        """One after the other; the order within each stays."""
        parts = [t.df.withColumn("part", F.lit(i)) for i, t in enumerate([self, *others])]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        # the part goes into the high digits, so no global sort is needed
        return Triplets(both.withColumn("triplet_ord", F.shiftleft(F.col("part").cast("long"), 48) + F.col("triplet_ord")).drop("part"), self.config, self.item)

    def last_wins(self) -> DataFrame:
        """(node_1, node_2, edge, metadata): one edge per pair, that of the last triplet."""
        last = F.max_by(F.struct("edge", "metadata"), "triplet_ord").alias("x")
        return self.df.groupBy("node_1", "node_2").agg(last).select("node_1", "node_2", "x.edge", "x.metadata")

    def nodes(self) -> DataFrame:
        return self.df.select(F.explode(F.array("node_1", "node_2")).alias("id")).distinct()

    def relations(self, deduplicated: bool = False) -> DataFrame:
        """Distinct relations, of all triplets or of the last per pair."""
        return (self.last_wins() if deduplicated else self.df).select(F.col("edge").alias("relation")).distinct()

    def neighbours(self, node: str, deduplicated: bool = False) -> DataFrame:
        """(src, relation, dst) around a node; of the deduplicated graph a self-loop shows twice, as out- and in-edge."""
        base = (self.last_wins() if deduplicated else self.df).select(F.col("node_1").alias("src"), F.col("edge").alias("relation"), F.col("node_2").alias("dst"))
        if deduplicated:
            return base.where(F.col("src") == node).unionByName(base.where(F.col("dst") == node))
        return base.where((F.col("src") == node) | (F.col("dst") == node))

    def within(self, nodes: DataFrame, deduplicated: bool = False) -> DataFrame:
        """Triplets with both ends among ``nodes`` (id): two semi-joins, broadcast by size only."""
        base = self.last_wins() if deduplicated else self.df
        ids = nodes.select("id").distinct()
        one = base.join(ids.withColumnRenamed("id", "node_1"), "node_1", "left_semi")
        return one.join(ids.withColumnRenamed("id", "node_2"), "node_2", "left_semi")

    def head(self, n: int) -> Triplets:
        return Triplets(self.df.orderBy("triplet_ord").limit(n), self.config, self.item)

    def text(self) -> DataFrame:
        """(triplet_ord, text): each as (a)-[r]->(b)."""
        return self.df.select("triplet_ord", triplet_text(F.col("node_1"), F.col("edge"), F.col("node_2")).alias("text"))

    def of_chunks(self, chunks: DataFrame) -> Triplets:
        """Triplets whose chunk is among ``chunks`` (chunk_id)."""
        own = self.df.withColumn("chunk_id", self.chunk_id())
        return Triplets(own.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi"), self.config, self.item)

    def by_snippet(self) -> tuple[Triplets, Triplets]:
        """Those that have a snippet, and those that don't."""
        has = F.coalesce(F.col("metadata")["snippet"], F.lit("")) != ""
        return Triplets(self.df.where(has), self.config, self.item), Triplets(self.df.where(~has), self.config, self.item)

    def chunk_id(self) -> Column:
        return F.col("metadata")["chunk_id"]

    def merged_with(self, other: Triplets) -> Triplets:
        """Metadata of equal triplets joined, the other's entries winning."""
        key = ["node_1", "edge", "node_2"]
        right = other.df.groupBy(*key).agg(F.max_by("metadata", "triplet_ord").alias("more"))
        both = self.df.join(right, key, "left").withColumn("metadata", merge_maps(F.col("metadata"), F.col("more"))).drop("more")
        return Triplets(both, self.config, self.item)

    def count(self) -> int:
        return self.df.count()

    def sources(self) -> DataFrame:
        """The triplets as provenance rows."""
        ident = triplet_id(F.col("node_1"), F.col("edge"), F.col("node_2"), F.col("metadata"), F.col("triplet_ord"))
        return self.df.select(F.col("node_1").alias("src"), F.col("edge").alias("relation"), F.col("node_2").alias("dst"), ident.alias("triplet_id"), F.col("triplet_ord").alias("ord"), "metadata")

    def numbered(self) -> Triplets:
        """With ordinals 0, 1, ... in order (a global sort, for exports)."""
        n = F.row_number().over(Window.orderBy("triplet_ord")) - 1
        return Triplets(self.df.withColumn("triplet_ord", n.cast("long")), self.config, self.item)


def merge_maps(a: Column, b: Column) -> Column:
    """b's entries win; either may be null."""
    b = F.coalesce(b, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce(a, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)
