"""Sources: triplet CSVs, versioned items, graph and subgraph JSON, embedding caches, JDBC, web pages."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph import schema
from tessergraph.functions.records import parse_metadata
from tessergraph.operators.graph import Graph
from tessergraph.operators.triplets import Triplets, merge_maps

CORE = ("node_1", "edge", "node_2")


def _csv(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def triplets_csv(spark: SparkSession, path: str) -> Triplets:
    """Every column but the three core ones becomes metadata. A missing core column is a ValueError."""
    df = _csv(spark, path)
    missing = set(CORE) - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(sorted(missing))}")
    more = [c for c in df.columns if c not in (*CORE, "metadata")]
    own = F.map_filter(F.create_map(*[x for c in more for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if more else F.create_map().cast(schema.MAP), lambda _, v: v.isNotNull())
    meta = merge_maps(parse_metadata(F.col("metadata")), own) if "metadata" in df.columns else own
    return Triplets(df.select(*CORE, meta.alias("metadata")))


def dataset_triplets(spark: SparkSession, base: str, version: str | None = None, skip_errors: bool = True) -> DataFrame:
    """(item_id, kg_version, node_1, edge, node_2, metadata) of all items: the named version, or each item's last by name.

    With skip_errors items without the version are left out, else they raise.
    """
    path = F.col("_metadata.file_path")
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("node_1 string, node_2 string, edge string, extra string").option("enforceSchema", True)
    raw = df.csv(f"{base.rstrip('/')}/*/kg/*/triplets.csv").select("*", F.regexp_extract(path, r"([^/]+)/kg/[^/]+/triplets\.csv$", 1).alias("item_id"), F.regexp_extract(path, r"/kg/([^/]+)/triplets\.csv$", 1).alias("kg_version"))
    latest = raw.groupBy("item_id").agg(F.max("kg_version").alias("kg_version"))
    chosen = raw.where(F.col("kg_version") == version) if version else raw.join(latest, ["item_id", "kg_version"], "left_semi")
    if version and not skip_errors:
        lost = raw.select("item_id").distinct().join(chosen.select("item_id"), "item_id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"{lost[0].item_id} has no version {version!r}")
    plain = ~F.startswith(F.col("extra"), F.lit("{"))
    meta = F.when(plain, F.create_map(F.lit("chunk_id"), "extra")).otherwise(parse_metadata(F.col("extra")))
    return chosen.select("item_id", "kg_version", "node_1", "edge", "node_2", meta.alias("metadata"))


def items_json(spark: SparkSession, base: str, without_version: str | None = None, seed: int | None = None, limit: int | None = None) -> DataFrame:
    """Records of all items that have a metadata.json, in the ITEM layout; items that have the version are left out; a seed shuffles."""
    df = spark.read.schema(schema.ITEM).option("multiLine", True).json(f"{base.rstrip('/')}/*/metadata.json")
    df = df.withColumn("item_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metadata\.json$", 1))
    if without_version:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "triplets.csv").load(base)
        have = files.select(F.regexp_extract("path", r"([^/]+)/kg/([^/]+)/triplets\.csv$", 1).alias("item_id"), F.regexp_extract("path", r"/kg/([^/]+)/triplets\.csv$", 1).alias("v"))
        df = df.join(have.where(F.col("v") == without_version), "item_id", "left_anti")
    if seed is not None:
        df = df.orderBy(F.xxhash64(F.lit(seed), "item_id"))
    return df.limit(limit) if limit else df


def graph_json(spark: SparkSession, path: str, domain: str | None = None, max_items: int | None = None, preserve_domains: bool = False) -> Graph:
    """A graph document, or a folder of those that graph_json wrote. All rows get the given domain unless preserve_domains; max_items keeps the first triplets only."""
    node = "struct<id:string,attributes:struct<domains:array<string>,attrs:map<string,string>>>"
    edge = "struct<source:string,target:string,attributes:struct<relation:string,domains:array<string>,attrs:map<string,string>,ord:bigint,sources:array<struct<triplet_id:string,ord:bigint,metadata:map<string,string>>>,part:bigint>>"
    doc = spark.read.schema(f"graph struct<nodes:array<{node}>,edges:array<{edge}>>").option("multiLine", True).json(path)
    mark = F.array(F.lit(domain)) if domain and not preserve_domains else None
    none = F.create_map().cast(schema.MAP)
    n = doc.select(F.explode("graph.nodes").alias("n")).select("n.id", (mark if mark is not None else F.col("n.attributes.domains")).alias("domains"), F.coalesce("n.attributes.attrs", none).alias("attrs"))
    e = doc.select(F.explode("graph.edges").alias("e")).select("e.source", "e.target", "e.attributes.*")
    # a part above 0 holds more occurrences of an edge that is elsewhere
    edges = e.where("coalesce(part, 0) = 0").select(F.col("source").alias("src"), "relation", F.col("target").alias("dst"), (mark if mark is not None else F.col("domains")).alias("domains"), F.coalesce("attrs", none).alias("attrs"), "ord")
    s = e.select(F.col("source").alias("src"), "relation", F.col("target").alias("dst"), F.explode("sources").alias("s")).select("src", "relation", "dst", "s.triplet_id", "s.ord", "s.metadata")
    graph = Graph(n, edges, s, domain)
    return Graph.build(graph.triplets().head(max_items), domain=domain) if max_items else graph


def subgraph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, nodes, edges) of subgraph documents, whose nodes are an object keyed by id."""
    edge = "struct<source:string,target:string,relation:string>"
    doc = spark.read.schema(f"subgraph_id string, graph_data struct<nodes:map<string,struct<domains:array<string>,attrs:map<string,string>>>,edges:array<{edge}>>, start_node string, end_node string, path_nodes array<string>, additional_nodes array<string>, context string, path_score int, path_score_justification string").option("multiLine", True).json(path)
    paths = doc.select(F.col("subgraph_id").alias("path_id"), F.col("start_node").alias("start"), F.col("end_node").alias("end"), F.col("path_nodes").alias("path"), "additional_nodes", "context", "path_score", "path_score_justification")
    nodes = doc.select(F.col("subgraph_id").alias("path_id"), F.explode(F.map_keys("graph_data.nodes")).alias("id"))
    edges = doc.select(F.col("subgraph_id").alias("path_id"), F.explode("graph_data.edges").alias("e")).select("path_id", F.col("e.source").alias("src"), "e.relation", F.col("e.target").alias("dst"))
    return paths, nodes, edges


def embedding_cache(spark: SparkSession, path: str, provider: str | None = None, model: str | None = None) -> tuple[DataFrame, str]:
    """((text, vec), metric) of a cache; another model of the same provider is a ValueError, another provider a warning."""
    doc = spark.read.schema("embedding_provider string, model_name string, distance_metric string, embeddings map<string,array<double>>").option("multiLine", True).json(path)
    head = doc.select("embedding_provider", "model_name", "distance_metric").first()
    if provider == head.embedding_provider and model is not None and model != head.model_name:
        raise ValueError(f"the cache is of {head.model_name}, not {model}")
    if provider is not None and provider != head.embedding_provider:
        warnings.warn(f"the cache is of {head.embedding_provider}, not {provider}", stacklevel=2)
    return doc.select(F.explode("embeddings").alias("text", "vec")), head.distance_metric


def jdbc(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, **options) -> DataFrame:
    """A table's rows; columns and condition are pushed to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def neo4j(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A Cypher query's rows through the public Neo4j connector, where its jar is on the class path."""
    return spark.read.format("org.neo4j.spark.DataSource").options(url=url, query=query, **options).load()


def exists(df: DataFrame, column: str, value) -> bool:
    return not df.where(F.col(column) == F.lit(value)).isEmpty()


def html_rows(pages: DataFrame, pattern: str = r"(?s)<tr[^>]*>(.*?)</tr>") -> DataFrame:
    """(page_id, pos, cells): table rows of pages, tags stripped from the cells."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", "")))
    return rows.select("page_id", "pos", cells.alias("cells"))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, title, n_links)."""
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


def yearly(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(year, proportion, count) rows of CSV lines inside texts, by year."""
    lines = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?m)^((?:19|20)\d\d,[\d.]+,\d+)$"), F.lit(1))).alias("line"))
    parts = F.split("line", ",")
    return lines.select(parts[0].cast("int").alias("year"), parts[1].cast("double").alias("proportion"), parts[2].cast("long").alias("count")).orderBy("year")
