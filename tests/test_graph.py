"""Literal graphs with known facts."""

import inspect

import pytest
from pyspark.sql import functions as F

from tessergraph.operators import paths, resolve
from tessergraph.operators.graph import Graph
from tessergraph.operators.subgraph import Subgraphs, additional_nodes
from tessergraph.operators.triplets import Triplets

LETTERS = [("A", "connects_to", "B"), ("B", "leads_to", "C"), ("C", "results_in", "D"), ("A", "relates_to", "E"), ("E", "influences", "D"), ("B", "interacts_with", "F"), ("G", "regulates", "C"), ("H", "binds_to", "A")]
DUPS = [("microglia", "undergoes", "activation", {"chunk_id": "chunk_1"}), ("microglia", "undergoes", "activation", {"chunk_id": "chunk_2"}), ("tau", "accumulates", "neurons"), ("amyloid", "forms", "plaques")]


def graph(spark, rows, domain="d"):
    return Graph.build(Triplets.of(spark, rows), domain=domain)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def ends(spark, *rows):
    return spark.createDataFrame([(f"{a}{b}", a, b) for a, b in rows], "path_id string, start string, end string")


def start(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "path_id string, start string")


def test_duplicates_keep_provenance(spark):
    g = graph(spark, DUPS)
    s = g.summary().first()
    assert (s.nodes, s.edges, s.relation_types) == (6, 3, 3)
    assert g.triplets().count() == 4
    n = {r.id: r.n_sources for r in g.provenance().collect()}
    assert n["microglia"] == 2 and n["tau"] == 1
    assert {r.n_sources for r in g.edge_provenance().where("src = 'microglia'").collect()} == {2}
    assert g.describe() == "Graph(nodes=6, edge_types=3, edges=3)"


def test_round_trip_is_a_multiset_identity(spark):
    rows = [("protein_A", "binds_to", "receptor_X", {"k": "v"}), ("protein_B", "activates", "enzyme_Y", {"z": "1"}), ("a", "r", "a", {})]
    got = graph(spark, rows).triplets().df.collect()
    assert sorted((r.node_1, r.edge, r.node_2, tuple(r.metadata.items())) for r in got) == sorted((a, e, b, tuple(m.items())) for a, e, b, m in rows)
    # a self-loop counts twice on its node
    assert {r.id: r.n_sources for r in graph(spark, rows).provenance().collect()}["a"] == 2


def test_adding_the_same_triplets_again_changes_nothing(spark):
    g = graph(spark, DUPS)
    again = g.add_triplets(Triplets.of(spark, DUPS))
    assert again.triplets().count() == 4 and again.number_of_edges() == 3


def test_upsert_attrs_and_domains(spark):
    g = graph(spark, LETTERS, "x")
    h = Graph(g.nodes, g.edges, g.sources, "y").add_nodes(spark.createDataFrame([("A", {"k": "1"}), ("Z", {"k": "2"})], "id string, attrs map<string,string>"))
    assert h.has_node("A") and h.has_node("Z") and not h.has_node("B")
    assert h.node_attrs("A") == {"k": "1"} and h.node_attrs("B") == {}
    assert {tuple(r.domains) for r in h.nodes.where("id = 'A'").collect()} == {("x", "y")}
    e = h.add_edges(spark.createDataFrame([("A", "new", "Z", {}), ("A", "new", "nowhere", {})], "src string, relation string, dst string, attrs map<string,string>"), require_ends=True)
    assert e.has_edge("A", "Z") and not e.has_edge("A", "nowhere") and not e.has_edge("A", "B")
    assert e.edge_attrs("A", "Z").first().ord > 7


def test_remove_nodes(spark):
    g = graph(spark, LETTERS).remove_nodes(spark.createDataFrame([("A",)], "id string"))
    assert "A" not in ids(g.nodes) and g.number_of_edges() == 5
    both = graph(spark, LETTERS, "x").nodes
    h = graph(spark, LETTERS, "x")
    h = Graph(both.withColumn("domains", F.array(F.lit("x"), F.lit("y"))), h.edges.withColumn("domains", F.array(F.lit("x"), F.lit("y"))), h.sources, "x")
    k = h.remove_nodes(spark.createDataFrame([("A",)], "id string"))
    assert "A" in ids(k.nodes) and not k.has_node("A")
    # the other domain still sees the edges
    assert Graph(k.nodes, k.edges, k.sources, "y").number_of_edges() == 8 and k.number_of_edges() == 5


def test_neighbourhoods(spark):
    g = graph(spark, LETTERS)
    a = spark.createDataFrame([("A",)], "id string")
    assert ids(g.successors(a), "neighbour") == ["B", "E"]
    assert ids(g.predecessors(a), "neighbour") == ["H"]
    assert ids(g.neighbours(a), "neighbour") == ["B", "E", "H"]
    assert g.successors(a, limit=1).count() == 1
    loop = graph(spark, [("x", "self_loop", "x")])
    assert loop.labelled_neighbourhood(spark.createDataFrame([("x",)], "id string")).count() == 2


def test_triplet_operators(spark):
    t = Triplets.of(spark, [("a", "r1", "b"), ("a", "r2", "b"), ("x", "r", "x")])
    assert ids(t.nodes()) == ["a", "b", "x"]
    assert ids(t.relations(), "relation") == ["r", "r1", "r2"] and ids(t.relations(True), "relation") == ["r", "r2"]
    assert t.neighbours("x").count() == 1 and t.neighbours("x", True).count() == 2
    assert t.within(spark.createDataFrame([("a",), ("b",)], "id string")).count() == 2
    assert [r.text for r in t.text().orderBy("triplet_ord").collect()][0] == "(a)-[r1]->(b)"
    assert t.head(1).count() == 1 and t.union(t).count() == 6
    m = t.merged_with(Triplets.of(spark, [("a", "r1", "b", {"k": "v"})])).df.where("edge = 'r1'").first().metadata
    assert m == {"k": "v"}
    with pytest.raises(ValueError):
        Triplets(spark.createDataFrame([("a",)], "node_1 string"))


def test_shortest_path_and_cypher(spark):
    g = graph(spark, [*LETTERS, ("X", "isolated", "Y")])
    p = paths.ShortestPath().paths(g, ends(spark, ("A", "D"), ("A", "X"), ("D", "D"), ("D", "H")))
    got = {r.path_id: r.path for r in p.collect()}
    assert got == {"AD": ["A", "E", "D"], "DD": ["D"], "DH": ["D", "E", "A", "H"]}
    assert "DA" not in {r.path_id for r in paths.shortest_paths(g, ends(spark, ("D", "A")), directed=True).collect()}
    sub = Subgraphs(g, p.where("path_id = 'AD'"))
    assert sub.cypher(full=False).first().cypher == "(A)-[:relates_to]->(E),\n(E)-[:influences]->(D)"
    assert sub.stats().first()[1:] == (3, 2, 3)
    assert [(r.source, r.relation, r.target) for r in paths.path_edges_last(g, p.where("path_id = 'AD'")).orderBy("pos").collect()] == [("A", "relates_to", "E"), ("E", "influences", "D")]
    with pytest.raises(ValueError):
        paths.ShortestPath().paths(g, ends(spark, ("A", "nope")))


def test_walk_edges_name_reverse_and_unknown(spark):
    g = graph(spark, LETTERS)
    p = spark.createDataFrame([("p", "B", "D", ["B", "A", "D"])], "path_id string, start string, end string, path array<string>")
    assert sorted(r.relation for r in paths.walk_edges(g, p).collect()) == ["REVERSE_connects_to", "unknown_relation"]
    assert sorted((r.src, r.dst) for r in paths.path_edges(g, p).collect()) == [("A", "B")]


def adjacent(g):
    return {(r.id, r.neighbour) for r in g.undirected().collect()}


def test_random_walks_keep_their_invariants(spark):
    g = graph(spark, LETTERS)
    ok = adjacent(g)
    one = {r.path_id: r.path for r in paths.RandomWalk(5, seed=1).paths(g, start(spark, "A", "D")).collect()}
    two = {r.path_id: r.path for r in paths.RandomWalk(5, seed=1).paths(g, start(spark, "A", "D").repartition(3)).collect()}
    assert one == two
    for s, p in one.items():
        assert p[0] == s and len(p) <= 6 and all(x in ok for x in zip(p, p[1:], strict=False))
    assert paths.RandomWalk(0).paths(g, start(spark, "A")).first().path == ["A"]
    for r in paths.RandomWalk(6, seed=2).paths(g, ends(spark, ("A", "D"), ("H", "C"))).collect():
        assert r.path[0] == r.start and r.path[-1] == r.end and all(x in ok for x in zip(r.path, r.path[1:], strict=False))


def test_embedding_path_backtracks(spark):
    g = graph(spark, [("A", "r", "B"), ("A", "r", "C"), ("C", "r", "D"), ("B", "r", "T")])
    vec = {"A": [0.0, 0.0], "B": [1.0, 0.0], "T": [4.9, 0.0], "C": [0.5, 0.0], "D": [5.0, 0.0]}
    v = spark.createDataFrame(list(vec.items()), "text string, vec array<double>")
    r = paths.EmbeddingPath(v).paths(g, ends(spark, ("A", "D"))).first()
    assert r.path == ["A", "C", "D"]


def test_randomized_shortest(spark):
    g = graph(spark, LETTERS)
    ok = adjacent(g)
    assert paths.RandomizedShortest(0).paths(g, ends(spark, ("A", "D"))).first().path == ["A", "E", "D"]
    p = paths.RandomizedShortest(0.9, waypoints=2, seed=5).paths(g, ends(spark, ("A", "D"))).first().path
    assert p[0] == "A" and p[-1] == "D" and all(x in ok for x in zip(p, p[1:], strict=False))


def test_model_walk_takes_longest_name_and_falls_back(spark):
    assert paths.chosen("NEXT_NODE: big cat sat", ["big", "big cat"]) == "big cat"
    assert paths.chosen("none", ["a"]) is None
    g = graph(spark, [("A", "r", "B c"), ("B c", "r", "D")])
    p = paths.ModelWalk(lambda s: "NEXT_NODE: B c" if "Path: A\n" in s else "?", 2).paths(g, start(spark, "A")).first().path
    assert p == ["A", "B c", "D"]
    loop = graph(spark, [("x", "self_loop", "x")])
    assert paths.ModelWalk(lambda s: "", 3).paths(loop, start(spark, "x")).first().path == ["x"]


def test_additional_nodes(spark):
    g = graph(spark, LETTERS)
    p = spark.createDataFrame([("p", "A", "D", ["A", "E", "D"])], "path_id string, start string, end string, path array<string>")
    assert ids(additional_nodes(g, p)) == ["B", "C", "H"]
    assert additional_nodes(g, p, 0.0).count() == 0
    assert additional_nodes(g, p, 1.0, 4).count() == 1 and additional_nodes(g, p, 1.0, 2).count() == 0
    with pytest.raises(ValueError):
        additional_nodes(g, p, 1.5)
    sub = Subgraphs(g, p, additional_nodes(g, p))
    assert ids(sub.nodes()) == ["A", "B", "C", "D", "E", "H"] and sub.edges().count() == 6
    assert len(sub.with_ids().first().subgraph_id) == 64
    scored = sub.scored(lambda s: "Fine path rating=4 indeed").first()
    assert scored.path_score == 4 and "rating" not in scored.path_score_justification
    assert sub.contextualised(lambda s: "ctx").first().context == "ctx"


# entity resolution


def variants(spark):
    return graph(spark, [("Protein", "binds", "Receptor", {"k": "1"}), ("protein", "acts", "receptor", {"k": "2"}), ("PROTEIN", "binds", "receptor_1", {"k": "3"}), ("Protein", "binds", "Receptor", {"k": "4"})])


def test_exact_merger(spark):
    g = variants(spark)
    m = resolve.ExactMerger()
    groups = m.groups(g)
    assert sorted(groups.groupBy("group_id").count().collect()) == [("protein", 3), ("receptor", 2)]
    assert {r.id: r.canonical for r in m.mapping(g).collect()} == {"Protein": "Protein", "protein": "Protein", "PROTEIN": "Protein", "Receptor": "Receptor", "receptor": "Receptor"}
    h = resolve.merge(g, m)
    assert ids(h.nodes) == ["Protein", "Receptor", "receptor_1"]
    assert h.triplets().count() == 4  # provenance is conserved
    assert {(r.relation, r.n_sources) for r in h.edge_provenance().where("dst = 'Receptor'").collect()} == {("binds", 2), ("acts", 1)}
    again = resolve.merge(h, m)
    assert ids(again.nodes) == ids(h.nodes) and again.triplets().count() == 4
    first = resolve.merge(g, m, first_relation=True)
    assert first.edges.where("dst = 'Receptor'").count() == 1 and first.triplets().count() == 4


def test_merge_pair_keeps_the_result(spark):
    g = graph(spark, [("gene_A", "r", "gene_B"), ("gene_B", "s", "gene_A"), ("gene_C", "t", "gene_A")])
    h = g.merge_pair("gene_A", "gene_C", "gene_A")
    assert ids(h.nodes) == ["gene_A", "gene_B"]
    assert sorted((r.src, r.relation, r.dst) for r in h.edges.collect()) == [("gene_A", "r", "gene_B"), ("gene_A", "t", "gene_A"), ("gene_B", "s", "gene_A")]


def vec_cache(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.95, 0.312]), ("c", [0.8, 0.6]), ("d", [0.0, 1.0]), ("z", [0.0, 0.0])]
    return spark.createDataFrame(rows, "text string, vec array<double>")


def test_embedding_merger_leaders_and_components(spark):
    g = graph(spark, [("a", "r", "b"), ("c", "r", "d"), ("c", "r", "z")])
    # a~b and b~c pass 0.93, a~c doesn't: a leader claims b, c stays; components join all three
    brute = resolve.EmbeddingMerger(vec_cache(spark), 0.93, "brute_force").groups(g)
    assert ids(brute) == ["a", "b"]
    ann = resolve.EmbeddingMerger(vec_cache(spark), 0.93, "ann", k=2).groups(g)
    assert ids(ann) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        resolve.EmbeddingMerger(vec_cache(spark), strategy="other")


def test_leaders_equal_the_sequential_rule(spark):
    import random

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(50)}
    claimed, want = {}, {}
    for i in range(30):
        if i not in claimed:
            for j in range(i + 1, 30):
                if j not in claimed and (i, j) in pairs:
                    claimed[j] = claimed[i] = i
    for i, lead in claimed.items():
        want.setdefault(lead, set()).add(i)
    got = {}
    for r in resolve.greedy_leaders(spark.createDataFrame(list(pairs), "a long, b long")).collect():
        got.setdefault(r.group_id, set()).add(r.id)
    assert got == want


def test_model_merger(spark):
    g = graph(spark, [("aa", "r", "ab"), ("zz", "r", "aa")])
    m = resolve.ModelMerger(lambda p: "0.9" if "1: aa\n2: ab" in p else ("score 0.1" if "How alike" in p else " joint "))
    assert ids(m.groups(g)) == ["aa", "ab"]
    h = resolve.merge(g, m)
    assert ids(h.nodes) == ["joint", "zz"] and h.triplets().count() == 2


def test_contraction_unites_attributes_in_a_stated_order(spark):
    nodes = [("Entity", {"a": "1", "own": "canonical"}), ("entity", {"a": "2", "b": "2"}), ("ENTITY", {"b": "3", "own": "no"}), ("z", {})]
    g = Graph.empty(spark).add_nodes(spark.createDataFrame(nodes, "id string, attrs map<string,string>"))
    g = g.add_edges(spark.createDataFrame([("entity", "r", "z", {"w": "1", "x": "1"}), ("ENTITY", "r", "z", {"w": "2"})], "src string, relation string, dst string, attrs map<string,string>"))
    m = spark.createDataFrame([(x, "Entity") for x in ("Entity", "entity", "ENTITY")], "id string, canonical string")
    c = g.contract(m)
    # names in order: ENTITY, entity, then the canonical's own
    assert c.node_attrs("Entity") == {"a": "1", "b": "2", "own": "canonical"}
    edges = c.edges.collect()
    assert len(edges) == 1 and set(edges[0].attrs) == {"w", "x"}


def test_searches_have_no_depth_unless_one_is_asked_for(spark):
    t = Triplets.of(spark, [(f"n{i}", "to", f"n{i + 1}") for i in range(7)])
    pairs = spark.createDataFrame([("p", "n0", "n7")], "path_id string, start string, end string")
    assert [len(r.path) for r in paths.ShortestPath().paths(Graph.build(t), pairs).collect()] == [8]
    assert paths.ShortestPath(5).paths(Graph.build(t), pairs).count() == 0
    for f in (paths.bfs_levels, paths.shortest_paths, paths.ShortestPath.__init__):
        assert inspect.signature(f).parameters["max_depth"].default is None


def test_chunks_snippets_and_random_nodes(spark):
    t = Triplets.of(spark, [("a", "r", "b", {"chunk_id": "1", "snippet": "a r b"}), ("c", "r", "d", {"chunk_id": "2"}), ("e", "r", "f")])
    assert [r.node_1 for r in t.of_chunks(spark.createDataFrame([("2",), ("2",)], "chunk_id string")).df.collect()] == ["c"]
    with_, without = t.by_snippet()
    assert [r.node_1 for r in with_.df.collect()] == ["a"] and sorted(r.node_1 for r in without.df.collect()) == ["c", "e"]
    g = Graph.build(t)
    assert g.random_node(3) == g.random_node(3) and g.has_node(g.random_node(3)) and Graph.empty(spark).random_node() is None
