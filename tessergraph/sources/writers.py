"""Sinks: CSV, JSON, Markdown, text, partitioned item versions, JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.operators.graph import KEY, Graph
from tessergraph.operators.triplets import Triplets
from tessergraph.schema import MAP


def triplets_csv(triplets: Triplets, path: str, snippet: bool = False) -> None:
    """node_1, node_2, edge and metadata as JSON; or with ``snippet`` the snippet alone."""
    last = F.coalesce(F.col("metadata")["snippet"], F.lit("")).alias("snippet") if snippet else F.to_json("metadata").alias("metadata")
    triplets.df.select("node_1", "node_2", "edge", last).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def triplets_markdown(triplets: Triplets, path: str, heading: str = "Triplets") -> None:
    line = F.concat(F.lit("- **"), "node_1", F.lit("** "), "edge", F.lit(" **"), "node_2", F.lit("**"), F.coalesce(F.concat(F.lit("\n  > "), F.col("metadata")["snippet"]), F.lit("")))
    rows = triplets.df.orderBy("triplet_ord").select(line.alias("value"))
    rows.sparkSession.createDataFrame([(f"# {heading}\n",)], "value string").unionByName(rows).coalesce(1).write.mode("overwrite").text(path)


def dataset_version(df: DataFrame, path: str) -> None:
    """Triplets with item_id and kg_version; only the written partitions are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("item_id", "kg_version").parquet(path)


def graph_tables(graph: Graph, path: str) -> None:
    """The graph as three Parquet tables, for any size."""
    for name in ("nodes", "edges", "sources"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def _by_order(x, y):
    """Maps have no order, so occurrences are sorted by ordinal, then id."""
    a, b = F.struct(x["ord"], x["triplet_id"]), F.struct(y["ord"], y["triplet_id"])
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _gathered(sources: DataFrame, *key: str) -> DataFrame:
    return sources.groupBy(*KEY, *key).agg(F.array_sort(F.collect_list(F.struct("ord", "triplet_id", "metadata")), _by_order).alias("s"))


def _node() -> Column:
    return F.struct("id", F.struct("domains", "attrs").alias("attributes"))


def _edge(*more: str) -> Column:
    own = F.transform("s", lambda x: F.struct(x["triplet_id"], x["ord"], x["metadata"])).alias("sources")
    return F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.struct("relation", "domains", "attrs", "ord", own, *more).alias("attributes"))


def _document() -> Column:
    return F.to_json(F.struct(F.struct("nodes", "edges").alias("graph"))).alias("json")


def graph_document(graph: Graph) -> DataFrame:
    """One row ``json``: the whole graph, all domains. For graphs that fit a document; else graph_json or graph_tables. Empty: ValueError."""
    if graph.nodes.isEmpty():
        raise ValueError("an empty graph isn't saved")
    nodes = graph.nodes.agg(F.collect_list(_node()).alias("nodes"))
    edges = graph.edges.join(_gathered(graph.sources), KEY, "left").agg(F.collect_list(_edge()).alias("edges"))
    return nodes.join(edges, how="cross").select(_document())  # one row each


def graph_documents(graph: Graph, n: int, size: int) -> DataFrame:
    """n rows ``json`` at most, each a document with a share of the nodes and edges, made in a task of its own.

    Of an edge that occurs more than ``size`` times each document takes a part of the occurrences; all but that of part 0 carry nothing else of it.
    """
    many = graph.sources.groupBy(*KEY).agg(F.ceil(F.count("*") / size).alias("k")).where("k > 1")
    parts = F.pmod(F.xxhash64("ord", "triplet_id"), F.coalesce("k", F.lit(1))).alias("part")
    sources = graph.sources.join(F.broadcast(many), KEY, "left").select(*graph.sources.columns, parts)  # a size-th of the occurrences at most
    own = _gathered(sources, "part").hint("merge")  # lists are larger than Spark takes them to be, and all of them must not be broadcast
    whole = graph.edges.join(own.where("part = 0"), KEY, "left").select(*KEY, "domains", "attrs", "ord", "s", F.lit(0).cast("long").alias("part"))
    rest = own.where("part > 0").select(*KEY, F.lit(None).cast("array<string>").alias("domains"), F.lit(None).cast(MAP).alias("attrs"), F.lit(None).cast("long").alias("ord"), "s", "part")
    at = lambda *key: F.pmod(F.xxhash64(*key), F.lit(n)).alias("doc")
    nodes = graph.nodes.select(at("id"), _node().alias("node"))
    edges = whole.unionByName(rest).select(at(*KEY, "part"), _edge("part").alias("edge"))
    both = nodes.unionByName(edges, allowMissingColumns=True).repartition(n, "doc")
    return both.groupBy("doc").agg(F.collect_list("node").alias("nodes"), F.collect_list("edge").alias("edges")).select(_document())


def graph_json(graph: Graph, path: str, size: int = 50_000) -> None:
    """A graph document; of a graph with more than ``size`` nodes, edges and occurrences several, a file each, which the reader takes as one graph. Empty: ValueError."""
    n = -(-(graph.nodes.count() + graph.edges.count() + graph.sources.count()) // size)
    docs = graph_document(graph).coalesce(1) if n < 2 else graph_documents(graph, n, size)
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def graph_cypher(graph: Graph, path: str) -> None:
    """A statement per edge, to load elsewhere."""
    graph.cypher().select(F.concat(F.lit("MERGE "), "cypher", F.lit(";")).alias("value")).write.mode("overwrite").text(path)


def edge_dump(graph: Graph) -> DataFrame:
    """(src, src_attrs, relation, attrs, dst, dst_attrs): all edges with both ends."""
    n = graph.nodes
    left = graph.edges.join(n.select(F.col("id").alias("src"), F.col("attrs").alias("src_attrs")), "src")
    return left.join(n.select(F.col("id").alias("dst"), F.col("attrs").alias("dst_attrs")), "dst").select("src", "src_attrs", "relation", "attrs", "dst", "dst_attrs")


def bodies(df: DataFrame, path: str, id_col: str, body_col: str = "body") -> None:
    """A text file per id, such as hypotheses as JSON or Markdown."""
    df.select(id_col, F.col(body_col).alias("value")).write.mode("overwrite").partitionBy(id_col).text(path)


def embedding_cache(vectors: DataFrame, path: str, provider: str = "", model: str = "", metric: str = "cosine") -> None:
    """The cache document that the reader takes: provider, model, metric and the vectors by text. For caches that fit a document; else embedding_table."""
    entries = F.map_from_entries(F.collect_list(F.struct("text", "vec"))).alias("embeddings")
    doc = vectors.select("text", "vec").agg(entries).select(F.lit(provider).alias("embedding_provider"), F.lit(model).alias("model_name"), F.lit(metric).alias("distance_metric"), "embeddings")
    doc.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def embedding_table(vectors: DataFrame, path: str) -> None:
    """(text, vec) as Parquet, for any size."""
    vectors.select("text", "vec").write.mode("overwrite").parquet(path)


def jdbc_triplets(triplets: Triplets, url: str, table: str, paper_hash: str, source_file: str, **options) -> None:
    rows = triplets.df.select(F.col("node_1").alias("subject"), F.col("edge").alias("predicate"), F.col("node_2").alias("object"), F.lit(paper_hash).alias("paper_hash"), F.lit(source_file).alias("source_file"))
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def updated(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """table with the non-null values of changes (same key) in place of its own; no rows are added."""
    cols = [c for c in changes.columns if c != key]
    right = changes.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return table.join(right, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns])
