"""What a worker, a task or the driver holds doesn't grow with the tables."""

import pytest

from tessergraph.functions import text
from tessergraph.operators import extraction


def test_chunks_leave_in_small_batches():
    """A worker used to hold all chunks of a batch of 10,000 texts."""
    rows = ((str(i), 0, "x" * 1000) for i in range(3000))
    sizes = [b.num_rows for b in text.flushed(rows, ("item_id", "pos", "text"), ("string", "int32", "string"))]
    assert sum(sizes) == 3000 and max(sizes) < 1100


def test_chunks_and_triplets_equal_the_plain_functions(spark):
    texts = {str(i): f"Protein{i} binds receptor. " * (i * 40) for i in range(6)} | {"n": None, "e": ""}
    items = spark.createDataFrame(list(texts.items()), "item_id string, text string")
    got = {(r.item_id, r.pos, r.chunk_id): r.text for r in text.chunk_fixed(items, "item_id", "text", 50, 5).collect()}
    assert got == {(i, p, f"{i}_{p}"): c for i, t in texts.items() for p, c in enumerate(text.fixed_chunks(t, 50, 5))}
    found = extraction.extract(text.chunk_fixed(items, "item_id", "text", 50, 5), extraction.rule_based, 3)
    want = {(c, n, *t, extraction.snippet_of(x, t)) for (_, _, c), x in got.items() for n, t in enumerate(extraction.rule_based(x))}
    assert {(r.chunk_id, r.n, r.node_1, r.edge, r.node_2, r.snippet) for r in found.collect()} == want and want


def test_exact_mapping_cuts_texts_once(spark, monkeypatch, tmp_path):
    """Groups, nodes and provenance used to cut all texts again, each for itself."""
    from tessergraph.plans import registry

    spark.createDataFrame([(1, "Protein protein binds PROTEIN protein"), (2, "binds Binds it")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.merge_exact_canonical(spark, str(tmp_path))
    assert {(r.id, r.canonical) for r in out.collect()} == {("Protein", "protein"), ("protein", "protein"), ("PROTEIN", "protein"), ("binds", "binds"), ("Binds", "binds")}
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_exact_merge_joins_each_edge_once(spark, tmp_path):
    """Edges and every occurrence used to be joined with the mapping, and then with each other: five joins."""
    from tessergraph.plans import registry

    spark.createDataFrame([(1, "Protein protein binds PROTEIN protein"), (2, "binds Binds it"), (3, "protein Binds it")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.merge_exact_contracted(spark, str(tmp_path))
    want = {("protein", "protein", 2), ("protein", "Binds", 2), ("Binds", "protein", 1), ("Binds", "Binds", 1), ("Binds", "it", 2)}
    assert {(r.src, r.dst, r.n_sources) for r in out.collect()} == want and {r.relation for r in out.collect()} == {"next"}
    assert joins(out) == 2


def test_first_relation_joins_each_edge_once(spark):
    """The first relation used to be found from edges that were mapped twice over, and joined with mapped occurrences."""
    from tessergraph.operators.graph import Graph
    from tessergraph.operators.triplets import Triplets

    rows = [("a", "r", "x1"), ("a", "q", "x2"), ("a", "r", "x1"), ("b", "p", "x2"), ("b", "o", "y"), ("a", "z", "a"), ("c", "u", "x1"), ("x2", "t", "c")]
    g = Graph.build(Triplets.of(spark, rows))
    m = spark.createDataFrame([("x1", "x"), ("x2", "x"), ("c", "b")], "id string, canonical string")
    h = g.contract(m, first_relation=True)
    out = h.edge_provenance()
    # a-r->x is last seen at 2, after a-q->x at 1
    want = {("a", "q", "x", 3), ("b", "p", "x", 2), ("b", "o", "y", 1), ("a", "z", "a", 1), ("x", "t", "b", 1)}
    assert {tuple(r) for r in out.collect()} == want and joins(out) == 2
    # counts agree with edges joined with sources
    plain = Graph(h.nodes, h.edges, h.sources)
    assert {tuple(r) for r in plain.edge_provenance().collect()} == want
    again = h.add_triplets(Triplets.of(spark, rows + [("a", "n", "x")]))
    assert {tuple(r) for r in again.edge_provenance().collect()} == {tuple(r) for r in Graph(again.nodes, again.edges, again.sources).edge_provenance().collect()}
    assert joins(h.edges) == 2


def test_known_triplets_are_found_by_short_ids(spark):
    """The join by id used to carry 64 characters a row, twice, for edges and for sources."""
    from pyspark.sql import functions as F

    from tessergraph.functions import ids
    from tessergraph.operators.graph import Graph
    from tessergraph.operators.triplets import Triplets

    named = ["0a" * 32, "0A" * 32, "0b" * 32, "0" * 31, "t1", "", "0a" * 16, "é" * 32]
    got = spark.createDataFrame([(x,) for x in named], "i string").select("i", ids.compact(F.col("i")).alias("c")).collect()
    assert len({bytes(r.c) for r in got}) == len(named) and {len(r.c) for r in got if r.i == "0a" * 32} == {33}
    rows = [("a", "r", "b"), ("a", "r", "b"), ("c", "r", "b")]
    g = Graph.build(Triplets.of(spark, rows[:2]), domain="d").add_triplets(Triplets.of(spark, rows))
    out = g.edge_provenance()
    assert {tuple(r) for r in out.collect()} == {("a", "r", "b", 2), ("c", "r", "b", 1)} and joins(out) == 1
    # edges that aren't those of the sources are still joined with them
    more = spark.createDataFrame([("a", "s", "b", {})], "src string, relation string, dst string, attrs map<string,string>")
    assert {tuple(r) for r in g.add_edges(more).edge_provenance().collect()} == {("a", "r", "b", 2), ("c", "r", "b", 1), ("a", "s", "b", 0)}
    assert Graph.build(Triplets.of(spark, rows), domain="d").remove_nodes(spark.createDataFrame([("c",)], "id string")).edge_provenance().count() == 1


def test_neighbours_join_each_pair_once(spark):
    """Successors and predecessors used to be made distinct and joined each for itself, and again together."""
    from tessergraph.operators.graph import Graph
    from tessergraph.operators.triplets import Triplets

    rows = [("a", "r", "b"), ("b", "q", "a"), ("a", "r", "c"), ("d", "r", "a"), ("a", "s", "a"), ("e", "r", "e"), ("z", "r", "f")]
    g = Graph.build(Triplets.of(spark, rows), domain="x")
    seen = g.add_nodes(spark.createDataFrame([("new", {})], "id string, attrs map<string,string>"))
    y = Graph(seen.nodes.where("id <> 'c'"), seen.edges, seen.sources, "x")
    ids = spark.createDataFrame([("a",), ("a",), ("e",), ("f",), ("c",), ("nobody",)], "id string")
    out = y.neighbours(ids)
    want = y.successors(ids).unionByName(y.predecessors(ids)).distinct()
    pairs = [("a", "a"), ("a", "b"), ("a", "d"), ("c", "a"), ("e", "e"), ("f", "z")]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) == pairs
    assert joins(out) == 2


def test_segmented_supply_is_joined_once(spark, tmp_path, monkeypatch):
    """Line items, orders and customers used to be joined for the edges, the frontier and the nodes, in up to six places of a plan."""
    from tessergraph.plans import registry

    write = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("customer", [(1, "BUILDING"), (2, "OTHER")], "c_custkey long, c_mktsegment string")
    write("orders", [(10, 1), (20, 2)], "o_orderkey long, o_custkey long")
    write("lineitem", [(10, 1, 5, 7, "R"), (10, 2, 5, 8, "A"), (20, 1, 6, 7, "R"), (20, 2, 6, 9, "N"), (20, 3, 6, 9, "A")], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string")
    got = {q: registry.QUERIES[q](spark, str(tmp_path)) for q in ("successors", "predecessors", "neighbors", "labelled_neighborhood")}
    rows = {q: sorted(map(tuple, df.collect())) for q, df in got.items()}
    assert rows["successors"] == [("S5", "P7"), ("S5", "P8"), ("S6", "P7")] and rows["predecessors"] == [("P7", "S5"), ("P8", "S5")]
    assert rows["neighbors"] == sorted(rows["successors"] + rows["predecessors"]) and len(rows["labelled_neighborhood"]) == 4
    assert not any("c_mktsegment" in df._jdf.queryExecution().optimizedPlan().toString() for df in got.values())
    # semi-joins would be pushed below the distinct and sorted in the task that gathers the pairs
    assert not any("LeftSemi" in got[q]._jdf.queryExecution().optimizedPlan().toString() for q in ("successors", "predecessors"))


def test_graph_json_is_written_in_bounded_documents(spark, tmp_path):
    """The whole graph used to be one row of one task, and one file."""
    import glob
    import json

    from tessergraph.operators.graph import Graph
    from tessergraph.operators.triplets import Triplets
    from tessergraph.sources import readers, writers

    hub = [("hub", "r", "end", {"k": str(i)}) for i in range(200)]
    g = Graph.build(Triplets.of(spark, hub + [(f"n{i}", "in", f"m{i % 7}", {"k": "v"}) for i in range(100)]), domain="d")
    g = g.add_edges(spark.createDataFrame([("n1", "bare", "n2", {"w": "1"})], "src string, relation string, dst string, attrs map<string,string>"))
    writers.graph_json(g, str(tmp_path / "g"), size=20)
    texts = [open(f).read() for f in glob.glob(str(tmp_path / "g" / "part-*"))]
    docs = [json.loads(t)["graph"] for t in texts if t]  # Spark leaves an empty file for an empty first partition
    held = [len(d["nodes"]) + len(d["edges"]) + sum(len(e["attributes"].get("sources", [])) for e in d["edges"]) for d in docs]
    assert len(docs) > 15 and max(held) < 100 and sum(len(d["nodes"]) for d in docs) == g.number_of_nodes()
    h = readers.graph_json(spark, str(tmp_path / "g"), "d", preserve_domains=True)
    rows = lambda df: sorted(str(r.asDict()) for r in df.collect())
    for name in ("nodes", "edges", "sources"):
        assert rows(getattr(h, name).select(*getattr(g, name).columns)) == rows(getattr(g, name)), name
    assert rows(h.edge_provenance()) == rows(g.edge_provenance())


def test_embedding_path_broadcasts_no_vectors_of_all_nodes(spark, monkeypatch):
    """The vectors of all nodes, twice a round, and all names, twice, used to go through the driver."""
    from pyspark.sql import functions as F

    from tessergraph.functions import vectors as V
    from tessergraph.operators import paths
    from tessergraph.operators.graph import Graph
    from tessergraph.operators.triplets import Triplets

    plans, keep = [], paths.saved

    def seen(df, name="round"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(paths, "saved", seen)
    g = Graph.build(Triplets.of(spark, [("A", "r", "B"), ("B", "r", "C"), ("C", "r", "D"), ("A", "r", "E")]))
    vecs = g.nodes.select(F.col("id").alias("text"), V.hashed(F.col("id")).alias("vec"))
    pairs = spark.createDataFrame([("p", "A", "D"), ("q", "D", "A"), ("s", "B", "B")], "path_id string, start string, end string")
    found = {r.path_id: r.path for r in paths.EmbeddingPath(vecs).paths(g, pairs).collect()}
    assert found["q"] == ["D", "C", "B", "A"] and found["p"][0] == "A" and found["p"][-1] == "D" and found["s"] == ["B"]
    rounds = [p for name, p in plans if name == "guided"][1:]
    assert rounds and all("SortMergeJoin [neighbour" in p for p in rounds) and any(name == "ends" for name, _ in plans)
    with pytest.raises(ValueError, match="end node not in the graph: Z"):
        paths.validate(g, pairs.withColumn("end", F.lit("Z")))
    with pytest.raises(ValueError, match="start node not in the graph: None"):
        paths.validate(g, pairs.withColumn("start", F.lit(None).cast("string")))
