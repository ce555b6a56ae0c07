"""The property multigraph: construction, mutation, filters and one-hop expansion.

Every method that asks for rows returns a lazy DataFrame; single answers (``has_node``) run
one small job.  A graph has one active domain; ``None`` sees all rows.
"""

from __future__ import annotations

from dataclasses import replace
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessergraph import schema
from tessergraph.functions.cypher import edge_text
from tessergraph.functions.ids import compact
from tessergraph.operators.triplets import Triplets, merge_maps
from tessergraph.runtime import saved

KEY = list(schema.EDGE_KEY)


def pick(seed: int, *columns) -> Column:
    """A draw that depends on the row and the seed, not on partitions or attempts."""
    return F.xxhash64(F.lit(seed), *columns)


@dataclass(frozen=True)
class Graph:
    """``counts`` (src, relation, dst, ord, n) is kept where the edges are those of the sources and all have the domain ``counted``.

    Its rows say how often an edge occurs: the sum of n is its number of sources and the greatest ord its own.
    """

    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame
    domain: str | None = None
    counts: DataFrame | None = None
    counted: str | None = None

    # construction

    @classmethod
    def empty(cls, spark: SparkSession, domain: str | None = None) -> Graph:
        return cls(spark.createDataFrame([], schema.NODE), spark.createDataFrame([], schema.EDGE), spark.createDataFrame([], schema.SOURCE), domain)

    @classmethod
    def build(cls, *triplets: Triplets, domain: str | None = None) -> Graph:
        """Nodes, edges and provenance of triplets, one after the other; nothing is there to be merged with, so each is one aggregation."""
        first, *rest = triplets
        sources = (first.union(*rest) if rest else first).sources()
        tags, none = F.array(F.lit(domain)) if domain else F.array().cast("array<string>"), F.create_map().cast(schema.MAP)
        nodes = sources.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", tags.alias("domains"), none.alias("attrs"))
        edges = sources.groupBy(*KEY).agg(F.max("ord").alias("ord")).select(*KEY, tags.alias("domains"), none.alias("attrs"), "ord")
        return cls(nodes, edges, sources, domain, _occurrences(sources), domain)

    @classmethod
    def tagged(cls, rows: DataFrame, tag: str = "tag", domain: str | None = None) -> Graph:
        """The graph of rows in the TRIPLET layout whose domain is in a column; a node or edge has all domains it occurs in."""
        none, sources = F.create_map().cast(schema.MAP), Triplets(rows).sources()
        all_tags = F.array_sort(F.collect_set(tag)).alias("domains")
        nodes = rows.select(F.explode(F.array("node_1", "node_2")).alias("id"), tag).groupBy("id").agg(all_tags).select("id", "domains", none.alias("attrs"))
        edges = rows.groupBy(F.col("node_1").alias("src"), F.col("edge").alias("relation"), F.col("node_2").alias("dst")).agg(all_tags, F.max("triplet_ord").alias("ord"))
        return cls(nodes, edges.select(*KEY, "domains", none.alias("attrs"), "ord"), sources, domain)

    def stored(self, *tables: str) -> Graph:
        """Nodes and edges, or the tables named, in the shared folder, for operators that read them several times."""
        return replace(self, **{t: saved(getattr(self, t), t)[0] for t in tables or ("nodes", "edges")})

    def tags(self) -> Column:
        return F.array(F.lit(self.domain)) if self.domain else F.array().cast("array<string>")

    def add_triplets(self, triplets: Triplets) -> Graph:
        """Upsert both ends and the edge of each triplet and append its provenance. Known triplets (same id) aren't added twice."""
        fresh = triplets.sources()
        if not self.sources.isEmpty():
            known = self.sources.select(compact(F.col("triplet_id")).alias("_known"))
            fresh = fresh.withColumn("_known", compact(F.col("triplet_id"))).join(known, "_known", "left_anti")
        fresh = fresh.select(*self.sources.columns)
        counts = self.counts.unionByName(_occurrences(fresh)) if self.counts is not None and self.counted == self.domain else None
        none = F.create_map().cast(schema.MAP)
        nodes = fresh.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", self.tags().alias("domains"), none.alias("attrs"))
        edges = fresh.groupBy(*KEY).agg(F.max("ord").alias("ord")).select(*KEY, self.tags().alias("domains"), none.alias("attrs"), "ord")
        return replace(self, nodes=merge_nodes_into(self.nodes, nodes), edges=merge_edges_into(self.edges, edges), sources=self.sources.unionByName(fresh), counts=counts)

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Upsert (id, attrs): given attributes win, the domain is added."""
        return replace(self, nodes=merge_nodes_into(self.nodes, nodes.select("id", self.tags().alias("domains"), F.col("attrs").cast(schema.MAP).alias("attrs"))))

    def add_edges(self, edges: DataFrame, require_ends: bool = False) -> Graph:
        """Upsert (src, relation, dst, attrs); an edge that exists moves to the end of the order. Ends are made, or with require_ends asked for."""
        own = edges.select(*KEY, self.tags().alias("domains"), F.col("attrs").cast(schema.MAP).alias("attrs"))
        nodes = self.nodes
        if require_ends:
            ids = self.nodes.select("id")
            own = own.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*KEY, "domains", "attrs")
        else:
            ends = own.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", self.tags().alias("domains"), F.create_map().cast(schema.MAP).alias("attrs"))
            nodes = merge_nodes_into(nodes, ends)
        last = self.edges.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
        own = own.join(last, how="cross").select(*own.columns, (F.col("last") + 1 + F.monotonically_increasing_id()).alias("ord"))  # last is one row
        return replace(self, nodes=nodes, edges=merge_edges_into(self.edges, own), counts=None)

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Take the active domain off the nodes (id). What has no domain left goes, with its edges; other domains' edges stay."""
        gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
        left = F.array_remove("domains", self.domain) if self.domain else F.array().cast("array<string>")
        marked = self.nodes.join(gone, "id", "left").withColumn("domains", F.when(F.col("_gone"), left).otherwise(F.col("domains")))
        stay = marked.where(F.col("_gone").isNull() | (F.size("domains") > 0)).select("id", "domains", "attrs")
        dead = marked.where(F.col("_gone") & (F.size("domains") == 0)).select("id")
        # an edge of the domain whose end left the domain leaves it too
        hit = lambda side: gone.withColumnRenamed("id", side).withColumnRenamed("_gone", f"_{side}")
        edges = self.edges.join(hit("src"), "src", "left").join(hit("dst"), "dst", "left")
        touched = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
        edges = edges.withColumn("domains", F.when(touched, left).otherwise(F.col("domains"))).where(~touched | (F.size("domains") > 0))
        edges = edges.select("src", "relation", "dst", "domains", "attrs", "ord")
        for side in ("src", "dst"):
            edges = edges.join(dead.withColumnRenamed("id", side), side, "left_anti").select(*self.edges.columns)
        return replace(self, nodes=stay, edges=edges, sources=self.sources.join(edges.select(*KEY), KEY, "left_semi").select(*self.sources.columns), counts=None)

    def contract(self, mapping: DataFrame, first_relation: bool = False) -> Graph:
        """Replace every id of mapping (id, canonical) by its canonical node.

        Relations and all provenance stay; edges between members become self-loops.  Attributes are united: of a
        node by the members' names, the canonical's own winning, of an edge by ordinal, the last winning.  first_relation keeps
        only the first relation of each resulting pair, with all of the pair's provenance.
        """
        m = mapping.select("id", "canonical").where("id <> canonical")
        to = lambda df, c: df.join(m.select(F.col("id").alias(c), F.col("canonical").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        members = to(self.nodes.withColumn("member", F.col("id")), "id")
        nodes = members.groupBy("id").agg(_domains(), _united((F.col("member") == F.col("id")).alias("own"), "member"))
        edges, sources = to(to(self.edges, "src"), "dst"), to(to(self.sources, "src"), "dst")
        edges = edges.groupBy(*KEY).agg(_domains(), _united("ord"), F.min("ord").alias("ord"))
        counts = self.counts
        if counts is not None:
            # an edge goes through the joins once, not each of its occurrences
            counts = to(to(counts.groupBy(*KEY).agg(F.max("ord").alias("ord"), F.sum("n").alias("n")), "src"), "dst")
            counts = counts.groupBy(*KEY).agg(F.min("ord").alias("ord"), F.sum("n").alias("n"))
        if first_relation:
            earliest, pairs = F.struct("ord", "relation"), ["src", "dst"]
            edges = edges.dropna(subset=pairs).groupBy(*pairs).agg(F.min_by(F.struct("relation", "domains", "attrs", "ord"), earliest).alias("e")).select(*pairs, "e.*")
            if counts is not None:
                counts = counts.dropna(subset=pairs).groupBy(*pairs).agg(F.min_by("relation", earliest).alias("relation"), F.min("ord").alias("ord"), F.sum("n").alias("n")).select(*self.counts.columns)
            first = edges.select(*pairs, F.col("relation").alias("_first"))
            sources = sources.join(first, ["src", "dst"]).withColumn("metadata", merge_maps(F.create_map(F.lit("relation"), F.col("relation")), F.col("metadata"))).withColumn("relation", F.col("_first"))
        return replace(self, nodes=nodes, edges=edges.select(*self.edges.columns), sources=sources.select(*self.sources.columns), counts=counts)

    def merge_pair(self, a: str, b: str, merged: str) -> Graph:
        """Two nodes become ``merged``, which may be one of them or new."""
        spark = self.nodes.sparkSession
        with_new = self.add_nodes(spark.createDataFrame([(merged, {})], f"id string, attrs {schema.MAP}"))
        return with_new.contract(spark.createDataFrame([(a, merged), (b, merged)], "id string, canonical string"))

    # filters and look-ups

    def _seen(self, df: DataFrame) -> DataFrame:
        return df.where(F.array_contains("domains", self.domain)) if self.domain else df

    def node_rows(self) -> DataFrame:
        return self._seen(self.nodes)

    def edge_rows(self) -> DataFrame:
        return self._seen(self.edges)

    def has_node(self, node: str) -> bool:
        return not self.node_rows().where(F.col("id") == node).isEmpty()

    def has_edge(self, src: str, dst: str) -> bool:
        return not self.edge_rows().where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def existing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.node_rows().select("id"), "id", "left_semi")

    def node_attrs(self, node: str) -> dict[str, str]:
        found = self.node_rows().where(F.col("id") == node).select("attrs").first()
        return found.attrs if found else {}

    def edge_attrs(self, src: str, dst: str) -> DataFrame:
        """Every parallel edge from src to dst."""
        return self.edge_rows().where((F.col("src") == src) & (F.col("dst") == dst))

    def relations(self) -> DataFrame:
        return self.edge_rows().select("relation").distinct()

    def relation_rollup(self) -> DataFrame:
        """(domain, relation, edges, sources_about) with totals per domain and over all (nulls): edges, and about how many distinct sources."""
        each = self.edge_rows().select(F.explode_outer("domains").alias("domain"), "relation", "src")
        return each.rollup("domain", "relation").agg(F.count("*").alias("edges"), F.approx_count_distinct("src").alias("sources_about"))

    def random_node(self, seed: int = 0) -> str | None:
        """A node drawn by hash; None from an empty graph."""
        found = self.node_rows().select("id").orderBy(pick(seed, "id"), "id").first()
        return found.id if found else None

    def number_of_nodes(self) -> int:
        return self.node_rows().count()

    def number_of_edges(self) -> int:
        return self.edge_rows().count()

    def is_empty(self) -> bool:
        return self.node_rows().isEmpty()

    def summary(self) -> DataFrame:
        """One row: nodes, edges, relation types, types per node and the mean degree."""
        n = self.node_rows().agg(F.count("*").alias("nodes"))
        e = self.edge_rows().agg(F.count("*").alias("edges"), F.countDistinct("relation").alias("relation_types"))
        both = n.join(e, how="cross")  # one row each
        return both.select("nodes", "edges", "relation_types", F.round(F.col("relation_types") / F.nullif("nodes", F.lit(0)), 6).alias("types_per_node"), F.round(2 * F.col("edges") / F.nullif("nodes", F.lit(0)), 6).alias("mean_degree"))

    def describe(self) -> str:
        r = self.summary().first()
        return f"Graph(nodes={r.nodes}, edge_types={r.relation_types}, edges={r.edges})"

    def triplets(self) -> Triplets:
        """One triplet per provenance row, and one without metadata for an edge that has none."""
        edges = self.edge_rows().select(*KEY, F.col("ord").alias("edge_ord"))
        rows = edges.join(self.sources, KEY, "left")
        meta = F.map_filter(F.coalesce("metadata", F.create_map().cast(schema.MAP)), lambda k, _: ~k.isin("relation", "triplet_id"))
        return Triplets(rows.select(F.coalesce("ord", "edge_ord").alias("triplet_ord"), F.col("src").alias("node_1"), F.col("relation").alias("edge"), F.col("dst").alias("node_2"), meta.alias("metadata")))

    def node_sources(self) -> DataFrame:
        """(id, relation, triplet_id, metadata): a self-loop counts twice."""
        return self.sources.select(F.explode(F.array("src", "dst")).alias("id"), "relation", "triplet_id", "ord", "metadata")

    def provenance(self) -> DataFrame:
        """(id, n_sources) of the domain's nodes."""
        counts = self.node_sources().groupBy("id").agg(F.count("*").alias("n"))
        return self.node_rows().select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_sources"))

    def edge_provenance(self) -> DataFrame:
        """(src, relation, dst, n_sources) of the domain's edges; without a join where ``counts`` has them."""
        if self.counts is not None and self.domain in (None, self.counted):
            return self.counts.groupBy(*KEY).agg(F.sum("n").alias("n_sources"))
        counts = self.sources.groupBy(*KEY).agg(F.count("*").alias("n_sources"))
        return self.edge_rows().select(*KEY).join(counts, KEY, "left").select(*KEY, F.coalesce("n_sources", F.lit(0)).alias("n_sources"))

    # one hop. ``frontier`` has a column id; results keep it as ``id``

    def successors(self, frontier: DataFrame, limit: int | None = None, seed: int = 0) -> DataFrame:
        """(id, neighbour): distinct targets, kept by the target node's domain; ``limit`` draws that many for each id."""
        return self._hop(frontier, "src", "dst", limit, seed)

    def predecessors(self, frontier: DataFrame, limit: int | None = None, seed: int = 0) -> DataFrame:
        return self._hop(frontier, "dst", "src", limit, seed)

    def _hop(self, frontier: DataFrame, near: str, far: str, limit: int | None, seed: int) -> DataFrame:
        # inner joins with distinct ids stay above the distinct, where semi-joins would be pushed below it: a task then sorts no pairs while it gathers them
        ids = lambda df, c: df.select(F.col("id").alias(c)).distinct().hint("shuffle_hash")
        pairs = self.edges.select(F.col(near).alias("id"), F.col(far).alias("neighbour")).distinct()
        kept = pairs.join(ids(frontier, "id"), "id").join(ids(self.node_rows(), "neighbour"), "neighbour").select("id", "neighbour")
        if limit is None:
            return kept
        order = Window.partitionBy("id").orderBy(pick(seed, "id", "neighbour"), "neighbour")
        return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")

    def neighbours(self, frontier: DataFrame) -> DataFrame:
        """(id, neighbour): distinct successors and predecessors. A pair of nodes goes through the joins once, whichever way its edges lead."""
        pairs = self.edges.dropna(subset=["src", "dst"]).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        marks = frontier.select("id", F.lit(True).alias("near"), F.lit(False).alias("far")).unionByName(self.node_rows().select("id", F.lit(False).alias("near"), F.lit(True).alias("far")))
        marks = marks.groupBy("id").agg(F.max("near").alias("near"), F.max("far").alias("far"))
        side = lambda c: marks.select(F.col("id").alias(c), F.col("near").alias(f"{c}_near"), F.col("far").alias(f"{c}_far"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")  # an end without a mark is neither of the frontier nor seen
        way = lambda x, y: F.when(F.col(f"{x}_near") & F.col(f"{y}_far"), F.struct(F.col(x).alias("id"), F.col(y).alias("neighbour")))
        back = F.when(F.col("a") != F.col("b"), way("b", "a"))
        return both.select(F.explode(F.array(way("a", "b"), back)).alias("p")).where("p IS NOT NULL").select("p.id", "p.neighbour")

    def out_edges(self, frontier: DataFrame) -> DataFrame:
        """Edges from the frontier, by the edge's domain."""
        return self.edge_rows().join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(*self.edges.columns)

    def in_edges(self, frontier: DataFrame) -> DataFrame:
        return self.edge_rows().join(frontier.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*self.edges.columns)

    def labelled_neighbourhood(self, frontier: DataFrame) -> DataFrame:
        """(id, src, relation, dst): out-edges and in-edges, a self-loop in both."""
        out = self.out_edges(frontier).select(F.col("src").alias("id"), *KEY)
        return out.unionByName(self.in_edges(frontier).select(F.col("dst").alias("id"), *KEY))

    def undirected(self) -> DataFrame:
        """(id, neighbour) of the domain's edges, both ways."""
        e = self.edge_rows()
        return e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("neighbour")))

    def cypher(self) -> DataFrame:
        return self.edge_rows().select(*KEY, edge_text(F.col("src"), F.col("relation"), F.col("dst")).alias("cypher"))


def merge_nodes_into(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: domains are united, the new row's attributes win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return _merged(both, ["id"]).select("id", "domains", "attrs")


def merge_edges_into(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return _merged(both, KEY, F.max("ord").alias("ord")).select(*KEY, "domains", "attrs", "ord")


def _occurrences(sources: DataFrame) -> DataFrame:
    return sources.select(*KEY, "ord", F.lit(1).cast("long").alias("n"))


def _domains() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains")


def _united(*order) -> Column:
    """Attributes of a group in one map; of a name's values the last in the order counts. Rows without any aren't gathered."""
    own = F.collect_list(F.when(F.size("attrs") > 0, F.struct(*order, F.map_entries("attrs").alias("e"))))
    return F.aggregate(F.array_sort(own), F.create_map().cast(schema.MAP), lambda a, x: merge_maps(a, F.map_from_entries(x["e"]))).alias("attrs")


def _merged(both: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """A union and one aggregation with map-side partials, in place of a full outer join. Rows of one key are few: one per write."""
    return both.groupBy(*key).agg(_domains(), _united("_new"), *more)
