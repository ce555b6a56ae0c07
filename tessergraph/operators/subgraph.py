"""Subgraphs around paths: sampling, induction, rendering, scoring, JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.functions import cypher, ids, text
from tessergraph.operators import paths as P
from tessergraph.operators.graph import Graph, pick
from tessergraph.operators.resolve import asked
from tessergraph.runtime import saved


def additional_nodes(graph: Graph, paths: DataFrame, probability: float = 1.0, max_nodes: int | None = None, seed: int = 0, keep=None) -> DataFrame:
    """(path_id, id): neighbours outside the path, each kept with the given probability, then cut at random to what max_nodes leaves.

    The path's length counts repeated nodes. A path longer than max_nodes gets none. ``keep`` replaces
    the draw by a condition on id.
    """
    if not 0 <= probability <= 1:
        raise ValueError("probability must lie between 0 and 1")
    on = paths.select("path_id", "path", F.explode(F.array_distinct("path")).alias("id"))
    near = on.join(P.arcs(graph, False), "id").where(~F.array_contains("path", F.col("neighbour"))).select("path_id", F.size("path").alias("n"), F.col("neighbour").alias("id")).distinct()
    if keep is not None:
        near = near.where(keep(F.col("id")))
    elif probability < 1:
        near = near.where(F.pmod(pick(seed, "path_id", "id"), F.lit(1_000_000)) < int(probability * 1_000_000))
    if max_nodes is not None:
        w = Window.partitionBy("path_id").orderBy(pick(seed + 1, "path_id", "id"), "id")
        near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_nodes - F.col("n"))
    return near.select("path_id", "id")


class Subgraphs:
    """Many induced subgraphs at once: paths, additional nodes, and the original graph they lie in."""

    def __init__(self, graph: Graph, paths: DataFrame, extra: DataFrame | None = None):
        self.graph, self.paths = graph, paths.where(F.size("path") > 0)
        self.extra = extra if extra is not None else paths.select("path_id", F.col("start").alias("id")).limit(0)

    @classmethod
    def from_pairs(cls, graph: Graph, pairs: DataFrame, generator: P.PairGenerator, probability: float = 1.0, max_nodes: int | None = None, seed: int = 0) -> Subgraphs:
        found, _ = saved(generator.paths(graph, pairs).select("path_id", "start", "end", "path"), "paths")
        return cls(graph, found, additional_nodes(graph, found, probability, max_nodes, seed))

    from_starts = from_pairs

    def members(self) -> DataFrame:
        on = self.paths.select("path_id", F.explode("path").alias("id"))
        return on.unionByName(self.extra).distinct()

    def nodes(self) -> DataFrame:
        """(path_id, id, domains, attrs)."""
        return self.members().join(self.graph.node_rows(), "id").select("path_id", "id", "domains", "attrs")

    def edges(self) -> DataFrame:
        """(path_id, src, relation, dst, ord) with both ends in the subgraph."""
        m = self.members()
        one = self.graph.edge_rows().join(m.select("path_id", F.col("id").alias("src")), "src")
        return one.join(m.select("path_id", F.col("id").alias("dst")), ["path_id", "dst"]).select("path_id", "src", "relation", "dst", "ord")

    def stats(self) -> DataFrame:
        """(path_id, node_count, edge_count, path_length)."""
        n = self.nodes().groupBy("path_id").agg(F.count("*").alias("node_count"))
        e = self.edges().groupBy("path_id").agg(F.count("*").alias("edge_count"))
        return self.paths.select("path_id", F.size("path").cast("long").alias("path_length")).join(n, "path_id", "left").join(e, "path_id", "left").select("path_id", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "path_length")

    def with_ids(self) -> DataFrame:
        """The paths with their subgraph_id."""
        extra = self.extra.groupBy("path_id").agg(F.array_sort(F.collect_set("id")).alias("additional"))
        both = self.paths.join(extra, "path_id", "left").withColumn("additional", F.coalesce("additional", F.array().cast("array<string>")))
        return both.withColumn("subgraph_id", ids.subgraph_id(F.col("start"), F.col("end"), F.col("path"), F.col("additional")))

    def cypher(self, full: bool = True) -> DataFrame:
        """(path_id, cypher): the path's edges in its order, then, if full, edges between pairs that aren't on it."""
        on, _ = saved(P.path_edges(self.graph, self.paths), "on")
        rows = on.select("path_id", F.lit(0).alias("part"), "pos", "src", "relation", "dst")
        if full:
            pairs = on.select("path_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
            rest = self.edges().withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst")).join(pairs, ["path_id", "lo", "hi"], "left_anti")
            rows = rows.unionByName(rest.select("path_id", F.lit(1).alias("part"), F.lit(0).alias("pos"), "src", "relation", "dst"))
        texts = rows.withColumn("text", cypher.edge_text(F.col("src"), F.col("relation"), F.col("dst")))
        return texts.groupBy("path_id").agg(cypher.joined("text", ["part", "pos", "src", "relation", "dst"]).alias("cypher"))

    def text(self) -> DataFrame:
        return self.paths.select("path_id", cypher.path_text(F.col("path")).alias("text"))

    def scored(self, model: Callable[[str], str], prompt: str = "Rate this path from 1 to 5 as rating=N and justify.") -> DataFrame:
        """(path_id, path_score, path_score_justification); no number leaves the score null."""
        told = self.cypher(full=False).select("path_id", asked(F.concat(F.lit(prompt + "\n"), "cypher"), model).alias("reply"))
        score, why = text.rating(F.col("reply"))
        return told.select("path_id", score.alias("path_score"), why.alias("path_score_justification"))

    def contextualised(self, model: Callable[[str], str], prompt: str = "Describe the context of this graph.") -> DataFrame:
        return self.cypher(full=True).select("path_id", asked(F.concat(F.lit(prompt + "\n"), "cypher"), model).alias("context"))

    def documents(self) -> DataFrame:
        """(subgraph_id, json): one JSON document per subgraph. Its size is the subgraph's, which max_nodes bounds."""
        own = self.with_ids()
        sources = self.graph.sources.groupBy("src", "relation", "dst").agg(F.array_sort(F.collect_list(F.to_json("metadata"))).alias("sources"))
        nodes = self.nodes().groupBy("path_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("domains", "attrs").alias("v"))), _by_id)).alias("nodes"))
        edges = self.edges().join(sources, ["src", "relation", "dst"], "left").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "sources"))).alias("edges"))
        hops = P.path_edges_last(self.graph, self.paths).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "target", "relation"))).alias("path_edges"))
        doc = own.join(nodes, "path_id", "left").join(edges, "path_id", "left").join(hops, "path_id", "left").join(self.stats(), "path_id")
        return doc.select("subgraph_id", F.to_json(F.struct("subgraph_id", F.struct("nodes", "edges").alias("graph_data"), F.struct("node_count", "edge_count", "path_length").alias("graph_stats"), F.col("start").alias("start_node"), F.col("end").alias("end_node"), F.col("path").alias("path_nodes"), "path_edges", F.col("additional").alias("additional_nodes"))).alias("json"))


def _by_id(x, y):
    return F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)


def best_scored(candidates: DataFrame, min_score: int = 3) -> DataFrame:
    """Of several attempts per pair (pair_id, attempt, path_score, ...) the first that reaches the score; pairs without one are left out."""
    w = Window.partitionBy("pair_id").orderBy("attempt")
    return candidates.where(F.col("path_score") >= min_score).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
