"""Command line: triplets from texts, graphs from triplets, subgraphs from graphs, statistics.

python -m tessergraph.cli {extract,ground,graph,subgraph,graph-stats} --help
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessergraph.functions.vectors import hashed
from tessergraph.operators import extraction, paths, resolve
from tessergraph.operators.graph import Graph
from tessergraph.operators.subgraph import Subgraphs
from tessergraph.operators.triplets import Triplets
from tessergraph.sources import readers, writers

EXPORTS = {"csv": writers.triplets_csv, "markdown": writers.triplets_markdown}


def timed(name: str, began: float) -> None:
    print(f"{name}: {time.time() - began:.1f} s")


def export(triplets: Triplets, path: str, kind: str) -> None:
    if kind not in EXPORTS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(EXPORTS)}")
    EXPORTS[kind](triplets, path)


def extract(spark: SparkSession, a) -> None:
    """Texts (<data>/<item>/*.txt) to triplets, with the rule-based extractor; models plug in through the library."""
    files = spark.read.text(f"{a.data}/*/*.txt", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("item_id"), F.col("value").alias("text"))
    found = extraction.generate(files.limit(a.max_items) if a.max_items else files, extraction.rule_based)
    export(extraction.triplets_of(found), a.output, a.format)


def ground(spark: SparkSession, a) -> None:
    """Adds snippets to the triplets of a CSV from chunks in Parquet (chunk_id, text)."""
    t = readers.triplets_csv(spark, a.data).df.select("node_1", "edge", "node_2", F.col("metadata")["chunk_id"].alias("chunk_id"), F.col("metadata")["snippet"].alias("snippet"))
    got = extraction.ground(t, spark.read.parquet(a.chunks))
    meta = F.map_filter(F.create_map(F.lit("chunk_id"), "chunk_id", F.lit("snippet"), "snippet"), lambda _, v: v.isNotNull())
    export(Triplets(got.select("node_1", "edge", "node_2", meta.alias("metadata"))), a.output, a.format)


def graph(spark: SparkSession, a) -> None:
    """All items' triplets to one graph, merged by case and, with a threshold, by hashed or cached vectors."""
    began = time.time()
    t = readers.dataset_triplets(spark, a.data, a.kg_version)
    if a.max_items:
        t = t.join(t.select("item_id").distinct().orderBy("item_id").limit(a.max_items), "item_id", "left_semi")
    g = resolve.merge(Graph.build(Triplets(t.select("node_1", "edge", "node_2", "metadata")), domain=a.domain), resolve.ExactMerger())
    if a.similarity_threshold:
        cache = readers.embedding_cache(spark, a.embeddings)[0] if a.embeddings else spark.createDataFrame([], "text string, vec array<double>")
        g = resolve.merge(g, resolve.EmbeddingMerger(cache, a.similarity_threshold, a.strategy, a.ann_k))
    writers.graph_tables(g, a.output)
    timed("graph", began)


def load(spark: SparkSession, path: str, domain: str | None) -> Graph:
    return Graph(*(spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("nodes", "edges", "sources")), domain)


GENERATORS = {
    "shortest_path": lambda a, g: paths.ShortestPath(),
    "random_walk": lambda a, g: paths.RandomWalk(a.max_steps, a.seed),
    "embedding": lambda a, g: paths.EmbeddingPath(g.nodes.select(F.col("id").alias("text"), hashed(F.col("id")).alias("vec")), seed=a.seed),
    "randomized_embedding": lambda a, g: paths.RandomizedShortest(seed=a.seed),
}


def subgraph(spark: SparkSession, a) -> None:
    """JSON documents of subgraphs between random pairs of nodes; a bounded number of candidates each, no retries without end."""
    g = load(spark, a.graph, a.domain)
    ends = g.node_rows().select("id").orderBy(F.xxhash64(F.lit(a.seed), "id")).limit(2 * a.num_subgraphs).collect()
    rows = [(str(i), ends[2 * i].id, ends[2 * i + 1].id) for i in range(len(ends) // 2)]
    pairs = spark.createDataFrame(rows, "path_id string, start string, end string")
    found = Subgraphs.from_pairs(g, pairs, GENERATORS[a.method](a, g), a.neighbor_probability, a.max_nodes, a.seed)
    found.documents().select(F.col("json").alias("value")).write.mode("overwrite").text(a.output)


def stats(spark: SparkSession, a) -> None:
    load(spark, a.graph, a.domain).summary().show(truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessergraph", description=__doc__)
    sub = p.add_subparsers(required=True)

    def add(name, run, *options):
        q = sub.add_parser(name, help=run.__doc__ and run.__doc__.split("\n")[0])
        q.set_defaults(run=run)
        for flag, kw in options:
            q.add_argument(flag, **kw)

    req, num, flt = {"required": True}, {"type": int}, {"type": float}
    add("extract", extract, ("--data", req), ("--output", req), ("--format", {"default": "csv"}), ("--max-items", num))
    add("ground", ground, ("--data", req), ("--chunks", req), ("--output", req), ("--format", {"default": "csv"}))
    add("graph", graph, ("--data", req), ("--output", req), ("--domain", req), ("--kg-version", {}), ("--max-items", num), ("--similarity-threshold", flt), ("--embeddings", {}), ("--strategy", {"default": "ann"}), ("--ann-k", num | {"default": 50}))
    add("subgraph", subgraph, ("--graph", req), ("--output", req), ("--domain", {}), ("--method", {"default": "shortest_path", "choices": list(GENERATORS)}), ("--num-subgraphs", num | {"default": 10}), ("--max-nodes", num | {"default": 20}), ("--max-steps", num | {"default": 10}), ("--neighbor-probability", flt | {"default": 0.5}), ("--seed", num | {"default": 0}))
    add("graph-stats", stats, ("--graph", req), ("--domain", {}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessergraph").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
