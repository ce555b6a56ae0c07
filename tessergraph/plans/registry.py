"""Named queries over the driver's tables and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.functions import cypher, ids, records, text
from tessergraph.functions import vectors as V
from tessergraph.operators import extraction, hypothesis, paths, resolve, similarity
from tessergraph.operators.components import connected_components
from tessergraph.operators.graph import Graph
from tessergraph.operators.subgraph import Subgraphs, additional_nodes
from tessergraph.operators.triplets import Triplets
from tessergraph.plans import views
from tessergraph.runtime import saved, shared_path
from tessergraph.sources import readers, writers
from tessergraph.sources.store import Store
from tessergraph.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SUPPLY = """t AS (SELECT concat('S', l_suppkey) AS node_1, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'pending' END AS edge,
  concat('P', l_partkey) AS node_2, l_orderkey, l_quantity, l_orderkey * 16 + l_linenumber AS ord FROM lineitem)"""
TAGGED = SUPPLY + """, g AS (SELECT t.*, c_mktsegment AS tag FROM t JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
nd AS (SELECT node_1 AS id, tag FROM g UNION SELECT node_2, tag FROM g)"""
GEO = """t AS (SELECT concat('N', n_nationkey) AS node_1, 'in' AS edge, concat('R', n_regionkey) AS node_2 FROM nation
  UNION ALL SELECT concat('C', c_custkey), 'lives in', concat('N', c_nationkey) FROM customer
  UNION ALL SELECT concat('S', s_suppkey), 'based-in', concat('N', s_nationkey) FROM supplier)"""
WORDS = """tok AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
t AS (SELECT w[i] AS node_1, 'next' AS edge, w[i + 1] AS node_2, doc_id FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM tok WHERE len(w) > 1))"""
ESCAPE = "CASE WHEN regexp_matches({0}, '[ \\-,()\\[\\]{{}}]') THEN '`' || {0} || '`' ELSE {0} END"
EDGE_TEXT = "'(' || {} || ')-[:' || {} || ']->(' || {} || ')'"


def _edge_text(a: str, r: str, b: str) -> str:
    return EDGE_TEXT.format(*(ESCAPE.format(x) for x in (a, r, b)))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# construction and provenance


@query(f"WITH {SUPPLY} SELECT id, count(*) AS n_sources FROM (SELECT node_1 AS id FROM t UNION ALL SELECT node_2 FROM t) GROUP BY id")
def kg_nodes_provenance(spark, d):
    return views.graph(views.supply(spark, d)).provenance()


@query(f"WITH {SUPPLY} SELECT node_1 AS src, edge AS relation, node_2 AS dst, count(*) AS n_sources FROM t GROUP BY ALL")
def kg_edges_agg(spark, d):
    return views.graph(views.supply(spark, d)).edge_provenance()


@query(f"WITH {SUPPLY} SELECT DISTINCT edge AS relation FROM t")
def kg_relation_types(spark, d):
    return views.graph(views.supply(spark, d)).relations()


@query(f"""WITH {SUPPLY}, n AS (SELECT count(*) AS nodes FROM (SELECT node_1 FROM t UNION SELECT node_2 FROM t)),
e AS (SELECT count(*) AS edges, count(DISTINCT edge) AS relation_types FROM (SELECT DISTINCT node_1, edge, node_2 FROM t))
SELECT nodes, edges, relation_types, round(relation_types / nodes, 6) AS types_per_node, round(2 * edges / nodes, 6) AS mean_degree FROM n, e""")
def kg_summary(spark, d):
    return views.graph(views.supply(spark, d)).summary()


@query(f"WITH {SUPPLY} SELECT ord AS triplet_ord, node_1, edge, node_2, CAST(l_orderkey AS VARCHAR) AS chunk_id FROM t")
def triplets_roundtrip(spark, d):
    return views.graph(views.supply(spark, d)).triplets().df.select("triplet_ord", "node_1", "edge", "node_2", F.col("metadata")["chunk_id"].alias("chunk_id"))


@query(f"WITH {SUPPLY} SELECT node_1, node_2, arg_max(edge, ord) AS edge, CAST(arg_max(l_orderkey, ord) AS VARCHAR) AS chunk_id FROM t GROUP BY node_1, node_2")
def triplets_last_wins(spark, d):
    return Triplets(views.supply(spark, d)).last_wins().select("node_1", "node_2", "edge", F.col("metadata")["chunk_id"].alias("chunk_id"))


@query(f"WITH {SUPPLY} SELECT node_1, edge, node_2, ord AS triplet_ord FROM t WHERE md5(node_1) < '8' AND md5(node_2) < '8'")
def triplets_subgraph(spark, d):
    t = Triplets(views.supply(spark, d))
    return t.within(t.nodes().where(F.md5(F.col("id").cast("binary")) < "8")).select("node_1", "edge", "node_2", "triplet_ord")


@query(f"WITH {SUPPLY} SELECT node_1 AS src, edge AS relation, node_2 AS dst FROM t WHERE node_1 = 'S1' OR node_2 = 'S1'")
def triplets_neighbours(spark, d):
    return Triplets(views.supply(spark, d)).neighbours("S1")


@query(f"WITH {SUPPLY} SELECT ord AS triplet_ord, '(' || node_1 || ')-[' || edge || ']->(' || node_2 || ')' AS text FROM t")
def triplets_text(spark, d):
    return Triplets(views.supply(spark, d)).text()


@query("SELECT o_custkey AS item, max('baseline_' || (o_orderkey % 12)) AS kg_version FROM orders GROUP BY o_custkey")
def version_latest(spark, d):
    v = views.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.concat(F.lit("baseline_"), F.col("o_orderkey") % 12).alias("v"))
    return v.groupBy("item").agg(F.max("v").alias("kg_version"))


# domains


@query(f"WITH {TAGGED} SELECT id FROM nd WHERE tag = 'BUILDING'")
def domain_nodes(spark, d):
    return views.segmented_supply(spark, d, "BUILDING").node_rows().select("id")


@query(f"WITH {TAGGED} SELECT DISTINCT node_1 AS src, edge AS relation, node_2 AS dst FROM g WHERE tag = 'BUILDING'")
def domain_edges(spark, d):
    return views.segmented_supply(spark, d, "BUILDING").edge_rows().select("src", "relation", "dst")


@query(f"""WITH {TAGGED}, x AS (SELECT id, tag FROM nd WHERE NOT (tag = 'BUILDING' AND md5(id) < '8'))
SELECT id, count(*) AS n_domains FROM x GROUP BY id""")
def remove_domain(spark, d):
    g = views.segmented_supply(spark, d, "BUILDING")
    left = g.remove_nodes(g.node_rows().select("id").where(F.md5(F.col("id").cast("binary")) < "8"))
    return left.nodes.select("id", F.size("domains").cast("long").alias("n_domains"))


@query(f"""WITH {TAGGED} SELECT DISTINCT node_1 AS id, node_2 AS neighbour FROM g WHERE node_2 IN (SELECT id FROM nd WHERE tag = 'BUILDING')""")
def successors(spark, d):
    g = views.segmented_supply(spark, d, "BUILDING", stored=True).stored("nodes")
    return g.successors(g.nodes.where("id LIKE 'S%'"))


@query(f"""WITH {TAGGED} SELECT DISTINCT node_2 AS id, node_1 AS neighbour FROM g WHERE node_1 IN (SELECT id FROM nd WHERE tag = 'BUILDING')""")
def predecessors(spark, d):
    g = views.segmented_supply(spark, d, "BUILDING", stored=True).stored("nodes")
    return g.predecessors(g.nodes.where("id LIKE 'P%'"))


@query(f"""WITH {TAGGED}, u AS (SELECT node_1 AS id, node_2 AS neighbour FROM g UNION SELECT node_2, node_1 FROM g)
SELECT id, neighbour FROM u WHERE neighbour IN (SELECT id FROM nd WHERE tag = 'BUILDING')""")
def neighbors(spark, d):
    g = views.segmented_supply(spark, d, "BUILDING", stored=True).stored("nodes")
    return g.neighbours(g.nodes)


@query(f"""WITH {TAGGED}, e AS (SELECT DISTINCT node_1, edge, node_2 FROM g WHERE tag = 'BUILDING')
SELECT node_1 AS id, node_1 AS src, edge AS relation, node_2 AS dst FROM e UNION ALL SELECT node_2, node_1, edge, node_2 FROM e""")
def labelled_neighborhood(spark, d):
    g = views.segmented_supply(spark, d, "BUILDING", stored=True).stored()
    return g.labelled_neighbourhood(g.nodes)


# paths


def _customer_paths(spark, d):
    """Customer, nation, region and the region's first nation: two forward hops and a reverse one."""
    c, n = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    p = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(first, "n_regionkey")
    node = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    path = F.array(node("C", "c_custkey"), node("N", "n_nationkey"), node("R", "n_regionkey"), node("N", "first"))
    return p.select(node("C", "c_custkey").alias("path_id"), path[0].alias("start"), path[3].alias("end"), path.alias("path"))


_PATHS = f"""WITH {GEO}, f AS (SELECT n_regionkey AS rk, min(n_nationkey) AS fn FROM nation GROUP BY 1),
p AS (SELECT 'C' || c_custkey AS path_id, ['C' || c_custkey, 'N' || n_nationkey, 'R' || n_regionkey, 'N' || fn] AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN f ON rk = n_regionkey),
h AS (SELECT path_id, i - 1 AS pos, path[i] AS a, path[i + 1] AS b FROM (SELECT path_id, path, unnest([1, 2, 3]) AS i FROM p))"""


@query(f"""{_PATHS} SELECT path_id, CAST(pos AS INTEGER) AS pos, node_1 AS src, edge AS relation, node_2 AS dst FROM h JOIN t ON node_1 = a AND node_2 = b
UNION ALL SELECT path_id, CAST(pos AS INTEGER), node_1, edge, node_2 FROM h JOIN t ON node_1 = b AND node_2 = a
WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.node_1 = h.a AND x.node_2 = h.b)""")
def path_edges(spark, d):
    return paths.path_edges(views.graph(views.geo(spark, d)), _customer_paths(spark, d))


@query(f"""{_PATHS} SELECT path_id, CAST(pos AS INTEGER) AS pos, a AS source, b AS target, coalesce(f.edge, r.edge, '') AS relation
FROM h LEFT JOIN t f ON f.node_1 = a AND f.node_2 = b LEFT JOIN t r ON r.node_1 = b AND r.node_2 = a""")
def path_edges_last(spark, d):
    return paths.path_edges_last(views.graph(views.geo(spark, d)), _customer_paths(spark, d))


@query(f"""{_PATHS} SELECT path_id, CAST(pos AS INTEGER) AS pos, a AS source, coalesce(f.edge, 'REVERSE_' || r.edge, 'unknown_relation') AS relation, b AS target
FROM h LEFT JOIN t f ON f.node_1 = a AND f.node_2 = b LEFT JOIN t r ON r.node_1 = b AND r.node_2 = a""")
def walk_edges(spark, d):
    return paths.walk_edges(views.graph(views.geo(spark, d)), _customer_paths(spark, d))


def _bfs_sql(both: bool) -> str:
    """The whole supply graph to exhaustion: a node is taken once, in the first round that reaches it."""
    back = " UNION SELECT node_2, node_1 FROM t" if both else ""
    return f"""WITH RECURSIVE {SUPPLY}, u AS (SELECT node_1 AS s, node_2 AS n FROM t{back}),
r(id, depth) USING KEY (id) AS (SELECT min(node_1), 0 FROM t UNION
  SELECT u.n, min(r.depth) + 1 FROM r JOIN u ON u.s = r.id LEFT JOIN recurring.r AS known ON known.id = u.n WHERE known.id IS NULL GROUP BY u.n)
SELECT 'root' AS path_id, id, CAST(depth AS INTEGER) AS depth FROM r"""


def _bfs(spark, d, directed):
    t = views.supply(spark, d)
    return paths.bfs_levels(views.graph(t), t.agg(F.min("node_1").alias("start")).withColumn("path_id", F.lit("root")), directed)


@query(_bfs_sql(False))
def bfs_levels_directed(spark, d):
    return _bfs(spark, d, True)


@query(_bfs_sql(True))
def bfs_levels_undirected(spark, d):
    return _bfs(spark, d, False)


def _nation_pairs(spark, d):
    n = views.table(spark, d, "nation")
    a = n.select("n_regionkey", F.concat(F.lit("N"), "n_nationkey").alias("start"))
    b = n.select("n_regionkey", F.concat(F.lit("N"), "n_nationkey").alias("end"))
    return a.join(b, "n_regionkey").where("start <> end").select(F.concat_ws(">", "start", "end").alias("path_id"), "start", "end")


@query("""SELECT 'N' || a.n_nationkey || '>N' || b.n_nationkey AS path_id, 'N' || a.n_nationkey || ' -> R' || a.n_regionkey || ' -> N' || b.n_nationkey AS path
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def shortest_path(spark, d):
    found = paths.ShortestPath().paths(views.graph(views.geo(spark, d)), _nation_pairs(spark, d))
    return found.select("path_id", cypher.path_text(F.col("path")).alias("path"))


def _starts(spark, d):
    return views.table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("path_id"), F.concat(F.lit("N"), "n_nationkey").alias("start"))


@query()
def random_walks(spark, d):
    return paths.RandomWalk(6, seed=7).paths(views.graph(views.geo(spark, d)), _starts(spark, d)).select("path_id", cypher.path_text(F.col("path")).alias("path"))


@query("""SELECT 'N' || a.n_nationkey || '>N' || b.n_nationkey AS path_id, CAST(3 AS BIGINT) AS nodes
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def embedding_path(spark, d):
    g = views.graph(views.geo(spark, d))
    # a nation's vector is near its region's, others are unrelated
    near = g.edges.where("relation = 'in'").select(F.col("src").alias("id"), F.col("dst").alias("region"))
    mixed = F.zip_with(V.hashed(F.coalesce("region", "id")), V.hashed(F.col("id")), lambda x, y: 0.9 * x + 0.1 * y)
    vecs = g.nodes.join(near, "id", "left").select(F.col("id").alias("text"), mixed.alias("vec"))
    return paths.EmbeddingPath(vecs, top_k=1).paths(g, _nation_pairs(spark, d)).select("path_id", F.size("path").cast("long").alias("nodes"))


@query()
def randomized_shortest(spark, d):
    return paths.RandomizedShortest(0.5, 1, seed=3).paths(views.graph(views.geo(spark, d)), _nation_pairs(spark, d)).select("path_id", cypher.path_text(F.col("path")).alias("path"))


def _first_listed(prompt: str) -> str:
    """A stand-in for a model: the first unvisited neighbour it is shown."""
    here = prompt.split("Path: ")[1].split("\n")[0].split(" -> ")[-1]
    for line in prompt.split("Neighbours:\n")[1].split("\n"):
        if not line.startswith("visited: ") and "]-> " in line:
            a, b = line.split(" -[")[0], line.split("]-> ")[1]
            return f"NEXT_NODE: {b if a == here else a}"
    return "no idea"


@query()
def model_walk(spark, d):
    return paths.ModelWalk(_first_listed, 4).paths(views.graph(views.geo(spark, d)), _starts(spark, d)).select("path_id", cypher.path_text(F.col("path")).alias("path"))


# subgraphs


def _nation_subgraphs(spark, d):
    g = views.graph(views.geo(spark, d))
    n = views.table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("start"), F.concat(F.lit("R"), "n_regionkey").alias("end"))
    p = n.select(F.col("start").alias("path_id"), "start", "end", F.array("start", "end").alias("path"))
    return Subgraphs(g, p, additional_nodes(g, p, keep=lambda c: F.md5(c.cast("binary")) < "4"))


_EXTRA = f"""WITH {GEO}, u AS (SELECT node_1 AS a, node_2 AS b FROM t UNION SELECT node_2, node_1 FROM t),
p AS (SELECT 'N' || n_nationkey AS path_id, 'N' || n_nationkey AS s, 'R' || n_regionkey AS e FROM nation),
x AS (SELECT DISTINCT path_id, b AS id FROM p JOIN u ON a IN (s, e) WHERE b NOT IN (s, e) AND md5(b) < '4'),
m AS (SELECT path_id, s AS id FROM p UNION SELECT path_id, e FROM p UNION SELECT path_id, id FROM x)"""


@query(f"{_EXTRA} SELECT path_id, id FROM x")
def additional_nodes_hash(spark, d):
    return _nation_subgraphs(spark, d).extra


@query(f"{_EXTRA} SELECT a.path_id AS path_id, node_1 AS src, edge AS relation, node_2 AS dst FROM t JOIN m a ON a.id = node_1 JOIN m b ON b.id = node_2 AND a.path_id = b.path_id")
def induced_subgraph(spark, d):
    return _nation_subgraphs(spark, d).edges().select("path_id", "src", "relation", "dst")


@query(f"""{_EXTRA}, i AS (SELECT a.path_id AS path_id FROM t JOIN m a ON a.id = node_1 JOIN m b ON b.id = node_2 AND a.path_id = b.path_id)
SELECT p.path_id AS path_id, (SELECT count(*) FROM m WHERE m.path_id = p.path_id) AS node_count, (SELECT count(*) FROM i WHERE i.path_id = p.path_id) AS edge_count, CAST(2 AS BIGINT) AS path_length FROM p""")
def subgraph_stats(spark, d):
    return _nation_subgraphs(spark, d).stats()


@query(f"""{_EXTRA}, i AS (SELECT a.path_id AS path_id, CASE WHEN edge = 'in' AND node_1 = a.path_id THEN 0 ELSE 1 END AS part, node_1, edge, node_2
  FROM t JOIN m a ON a.id = node_1 JOIN m b ON b.id = node_2 AND a.path_id = b.path_id)
SELECT path_id, string_agg({_edge_text('node_1', 'edge', 'node_2')}, ',' || chr(10) ORDER BY part, node_1, edge, node_2) AS cypher FROM i GROUP BY path_id""")
def cypher_subgraph(spark, d):
    return _nation_subgraphs(spark, d).cypher()


@query(f"WITH {GEO} SELECT node_1 AS src, edge AS relation, node_2 AS dst, {_edge_text('node_1', 'edge', 'node_2')} AS cypher FROM t")
def cypher_edges(spark, d):
    return views.graph(views.geo(spark, d)).cypher()


@query()
def subgraph_documents(spark, d):
    return _nation_subgraphs(spark, d).documents()


# entity resolution


_CANON = f"""WITH {WORDS}, c AS (SELECT id, count(*) AS n FROM (SELECT node_1 AS id FROM t UNION ALL SELECT node_2 FROM t) GROUP BY id),
m AS (SELECT id, lower(id) AS group_id, first_value(id) OVER (PARTITION BY lower(id) ORDER BY n DESC, id) AS canonical, count(*) OVER (PARTITION BY lower(id)) AS k FROM c)"""


@query(f"{_CANON} SELECT group_id, id FROM m WHERE k > 1")
def merge_exact_groups(spark, d):
    return resolve.ExactMerger().groups(views.graph(views.words(spark, d)))


@query(f"{_CANON} SELECT id, canonical FROM m WHERE k > 1")
def merge_exact_canonical(spark, d):
    words, _ = saved(views.words(spark, d), "words")  # groups and provenance both read them
    return resolve.ExactMerger().mapping(views.graph(words))


@query(f"{_CANON} SELECT a.canonical AS src, edge AS relation, b.canonical AS dst, count(*) AS n_sources FROM t JOIN m a ON a.id = node_1 JOIN m b ON b.id = node_2 GROUP BY ALL")
def merge_exact_contracted(spark, d):
    words, _ = saved(views.words(spark, d), "words")  # mapping, edges and provenance all read them
    return resolve.merge(views.graph(words), resolve.ExactMerger()).edge_provenance()


_PAIRS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT x.id AS a, y.id AS b, {} AS sim FROM v x JOIN v y ON x.id < y.id)"
_COS = "list_cosine_similarity(x.e, y.e)"


def _pair_query(metric: str, threshold: float):
    return lambda spark, d: similarity.similar_pairs(views.vectors(spark, d), threshold, metric).select("a", "b", F.round("sim", 6).alias("sim"))


for _name, _metric, _threshold, _expr in (("sim_pairs_cosine", "cosine", 0.35, _COS), ("sim_pairs_l2", "euclidean", 0.47, "1 / (1 + list_distance(x.e, y.e))"), ("sim_pairs_dot", "dot_product", 0.35, "list_inner_product(x.e, y.e)")):
    QUERIES[_name] = _pair_query(_metric, _threshold)
    ORACLES[_name] = f"WITH {_PAIRS.format(_expr)} SELECT a, b, round(sim, 6) AS sim FROM s WHERE sim >= {_threshold}"


@query(f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT x.id AS a, y.id AS b, round({_COS}, 9) AS sim FROM v x JOIN v y ON x.id <> y.id),
r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s)
SELECT a, b, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def knn_topk(spark, d):
    return similarity.nearest(views.vectors(spark, d), 5).select("a", "b", F.round("sim", 6).alias("sim"), "rank")


@query(f"""WITH RECURSIVE {_PAIRS.format(_COS)}, p AS (SELECT a, b FROM s WHERE sim >= 0.4), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, l) AS (SELECT a, a FROM u UNION SELECT u.b, r.l FROM r JOIN u ON u.a = r.id) SELECT id, min(l) AS component FROM r GROUP BY id""")
def similarity_components(spark, d):
    return connected_components(similarity.similar_pairs(views.vectors(spark, d), 0.4))


def _leaders_sql(threshold: float, name: str = "vec_id") -> str:
    """Leader clustering by a loop over the ids in order: an id leads unless one of its smaller partners does."""
    return f"""WITH RECURSIVE v AS (SELECT {name} AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id AND {_COS} >= {threshold}),
s AS (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce((SELECT list(a ORDER BY a) FROM p WHERE p.b = v.id), []) AS smaller FROM v),
r(k, id, led, leader) AS (SELECT CAST(0 AS BIGINT), min(id), list(id)[:0], min(id) FROM v UNION ALL
  SELECT s.k, s.id, CASE WHEN len(list_intersect(s.smaller, r.led)) = 0 THEN list_append(r.led, s.id) ELSE r.led END,
    coalesce(list_min(list_intersect(s.smaller, r.led)), s.id) FROM r JOIN s ON s.k = r.k + 1),
g AS (SELECT leader AS group_id, id, count(*) OVER (PARTITION BY leader) AS n FROM r WHERE k > 0)
SELECT group_id, id FROM g WHERE n > 1"""


@query(_leaders_sql(0.35))
def greedy_leader_clusters(spark, d):
    return resolve.greedy_leaders(similarity.similar_pairs(views.vectors(spark, d), 0.35))


def _named_vectors(spark, d):
    """A graph whose nodes are the vectors' names, and the cache of their vectors."""
    cache = views.vectors(spark, d).select(F.concat(F.lit("V"), "id").alias("text"), "vec")
    nodes = cache.select(F.col("text").alias("id"), F.create_map().cast("map<string,string>").alias("attrs"))
    return Graph.empty(spark).add_nodes(nodes), cache


@query(_leaders_sql(0.35, "'V' || vec_id"))
def merge_by_vectors_brute_force(spark, d):
    g, cache = _named_vectors(spark, d)
    return resolve.EmbeddingMerger(cache, 0.35, "brute_force").groups(g)


@query(f"""WITH RECURSIVE v AS (SELECT 'V' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT x.id AS a, y.id AS b, {_COS} AS sim FROM v x JOIN v y ON x.id <> y.id),
k AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS r FROM s),
u AS (SELECT a, b FROM k WHERE r <= 50 AND sim >= 0.4 UNION SELECT b, a FROM k WHERE r <= 50 AND sim >= 0.4),
c(id, l) AS (SELECT a, a FROM u UNION SELECT u.b, c.l FROM c JOIN u ON u.a = c.id) SELECT min(l) AS group_id, id FROM c GROUP BY id""")
def merge_by_vectors_nearest(spark, d):
    g, cache = _named_vectors(spark, d)
    return resolve.EmbeddingMerger(cache, 0.4, "ann").groups(g)


_FIRST_PAIRS = """i AS (SELECT id FROM (SELECT 'N' || n_nationkey AS id FROM nation UNION SELECT 'R' || n_regionkey FROM nation UNION SELECT 'C' || c_custkey FROM customer
  UNION SELECT 'S' || s_suppkey FROM supplier UNION SELECT 'N' || c_nationkey FROM customer UNION SELECT 'N' || s_nationkey FROM supplier) ORDER BY id LIMIT 1001),
p AS (SELECT x.id AS a, y.id AS b FROM i x JOIN i y ON x.id < y.id ORDER BY 1, 2 LIMIT 1000)"""


def _same_end(prompt: str) -> str:
    """A stand-in for a model: alike, if the names end in the same digit."""
    a, b = (line.split(": ")[1] for line in prompt.split("\n")[1:3])
    return "score 0.9" if a[-1:] == b[-1:] else "0.1"


@query(f"""WITH RECURSIVE {_FIRST_PAIRS}, u AS (SELECT a, b FROM p WHERE right(a, 1) = right(b, 1) UNION SELECT b, a FROM p WHERE right(a, 1) = right(b, 1)),
c(id, l) AS (SELECT a, a FROM u UNION SELECT u.b, c.l FROM c JOIN u ON u.a = c.id) SELECT min(l) AS group_id, id FROM c GROUP BY id""")
def merge_by_model_groups(spark, d):
    return resolve.ModelMerger(_same_end).groups(views.graph(views.geo(spark, d)))


@query(f"""WITH {_PAIRS.split(', s AS')[0]}, q AS (SELECT e AS qe FROM v WHERE id = 0)
SELECT id, round(1 - list_cosine_similarity(e, qe), 6) AS distance FROM v, q ORDER BY round(1 - list_cosine_similarity(e, qe), 9), id LIMIT 5""")
def top_matches(spark, d):
    rows = views.vectors(spark, d)
    probe = rows.where("id = 0").first().vec
    return similarity.top_matches(rows, probe, 5).select("id", F.round("distance", 6).alias("distance"))


# mutation, walks and files


@query(f"WITH {SUPPLY} SELECT node_1 AS src, edge AS relation, node_2 AS dst, count(*) AS n_sources FROM t GROUP BY ALL")
def kg_add_triplets(spark, d):
    """Half of the triplets, then all of them: what is known isn't added twice."""
    t = views.supply(spark, d)
    return Graph.build(Triplets(t.where("l_orderkey % 2 = 0"))).add_triplets(Triplets(t)).edge_provenance()


@query(f"""WITH {GEO}, n AS (SELECT node_1 AS id FROM t UNION SELECT node_2 FROM t UNION SELECT 'X' || s_suppkey FROM supplier)
SELECT id, s_name AS name, CAST(CASE WHEN s_name IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_attrs FROM n LEFT JOIN supplier ON id IN ('S' || s_suppkey, 'X' || s_suppkey)""")
def kg_upsert_nodes(spark, d):
    """Names for the suppliers' nodes, and new nodes beside them."""
    s = views.table(spark, d, "supplier")
    named = lambda p: s.select(F.concat(F.lit(p), "s_suppkey").alias("id"), F.create_map(F.lit("name"), "s_name").alias("attrs"))
    g = views.graph(views.geo(spark, d)).add_nodes(named("S")).add_nodes(named("X"))
    return g.nodes.select("id", F.col("attrs")["name"].alias("name"), F.size("attrs").cast("long").alias("n_attrs"))


@query(f"""WITH {GEO}, e AS (SELECT * FROM t UNION SELECT 'S' || s_suppkey, 'serves', 'C' || s_suppkey FROM supplier JOIN customer ON s_suppkey = c_custkey)
SELECT node_1 AS src, edge AS relation, node_2 AS dst FROM e""")
def kg_upsert_edges(spark, d):
    """Edges between known nodes only: suppliers serve the customer of their number, if there is one."""
    new = views.table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.lit("serves").alias("relation"), F.concat(F.lit("C"), "s_suppkey").alias("dst"), F.create_map().cast("map<string,string>").alias("attrs"))
    return views.graph(views.geo(spark, d)).add_edges(new, require_ends=True).edges.select("src", "relation", "dst")


@query("""WITH m AS (SELECT 'S' || (s_suppkey - s_suppkey % 10 + 1) AS canonical, 'S' || s_suppkey AS id, 'k' || (s_suppkey % 3) AS k, s_name AS v FROM supplier)
SELECT canonical AS id, k AS name, arg_max(v, CASE WHEN id = canonical THEN '1' ELSE '0' END || id) AS value FROM m GROUP BY ALL""")
def contract_unites_attributes(spark, d):
    """Suppliers by tens become one; names clash, the canonical's own wins, then the last member's."""
    s = views.table(spark, d, "supplier")
    node = F.concat(F.lit("S"), "s_suppkey")
    named = s.select(node.alias("id"), F.create_map(F.concat(F.lit("k"), F.col("s_suppkey") % 3), F.col("s_name")).alias("attrs"))
    mapping = s.select(node.alias("id"), F.concat(F.lit("S"), F.col("s_suppkey") - F.col("s_suppkey") % 10 + 1).alias("canonical"))
    g = Graph.empty(spark).add_nodes(named).contract(mapping)
    return g.nodes.select("id", F.explode("attrs").alias("name", "value"))


@query(f"""WITH {SUPPLY}, e AS (SELECT node_1, edge, node_2, max(ord) AS ord FROM t GROUP BY ALL), m AS (SELECT node_1, edge, 'P' || (CAST(node_2[2:] AS BIGINT) % 50) AS node_2, ord FROM e),
f AS (SELECT node_1, node_2, arg_min(edge, ord) AS edge FROM m GROUP BY ALL), c AS (SELECT node_1, 'P' || (CAST(node_2[2:] AS BIGINT) % 50) AS node_2, count(*) AS n FROM t GROUP BY ALL)
SELECT f.node_1 AS src, edge AS relation, f.node_2 AS dst, n AS n_sources FROM f JOIN c ON f.node_1 = c.node_1 AND f.node_2 = c.node_2""")
def contract_first_relation(spark, d):
    """Parts fall into 50 kinds; a pair keeps its first relation and all provenance."""
    parts = views.table(spark, d, "lineitem").select("l_partkey").distinct()
    mapping = parts.select(F.concat(F.lit("P"), "l_partkey").alias("id"), F.concat(F.lit("P"), F.col("l_partkey") % 50).alias("canonical"))
    return views.graph(views.supply(spark, d)).contract(mapping, first_relation=True).edge_provenance()


@query(f"WITH {SUPPLY}, n AS (SELECT node_1 AS id FROM t UNION SELECT node_2 FROM t) SELECT id FROM n WHERE id IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 10)")
def existing_nodes(spark, d):
    asked = views.table(spark, d, "part").where("p_size < 10").select(F.concat(F.lit("P"), "p_partkey").alias("id"))
    return views.graph(views.supply(spark, d)).existing(asked)


@query(f"WITH {TAGGED}, e AS (SELECT DISTINCT tag, node_1, edge, node_2 FROM g) SELECT tag AS domain, edge AS relation, count(*) AS edges FROM e GROUP BY ROLLUP (tag, edge)")
def relation_rollup(spark, d):
    return views.segmented_supply(spark, d).relation_rollup().select("domain", "relation", "edges")


@query(f"WITH {SUPPLY} SELECT id, edge AS relation, count(*) AS n FROM (SELECT node_1 AS id, edge FROM t UNION ALL SELECT node_2, edge FROM t) GROUP BY ALL")
def node_sources(spark, d):
    return views.graph(views.supply(spark, d)).node_sources().groupBy("id", "relation").agg(F.count("*").alias("n"))


@query(f"WITH {GEO} SELECT node_1 AS src, edge AS relation, node_2 AS dst FROM t")
def edge_dump(spark, d):
    return writers.edge_dump(views.graph(views.geo(spark, d))).select("src", "relation", "dst")


@query(f"WITH {GEO} SELECT node_1 AS src, edge AS relation, node_2 AS dst, count(*) AS n_sources FROM t GROUP BY ALL")
def graph_json_roundtrip(spark, d):
    """The geography as a graph document, written and read again."""
    path = shared_path(spark, "graph-json")
    writers.graph_json(views.graph(views.geo(spark, d)), path)
    return readers.graph_json(spark, path).edge_provenance()


@query(f"WITH {SUPPLY} SELECT node_1, edge, node_2, CAST(l_orderkey AS VARCHAR) AS chunk_id FROM t")
def triplets_csv_roundtrip(spark, d):
    path = shared_path(spark, "triplets-csv")
    writers.triplets_csv(Triplets(views.supply(spark, d)), path)
    return readers.triplets_csv(spark, path).df.select("node_1", "edge", "node_2", F.col("metadata")["chunk_id"].alias("chunk_id"))


@query("SELECT 'V' || vec_id AS text, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def embedding_cache_roundtrip(spark, d):
    path = shared_path(spark, "cache")
    writers.embedding_cache(_named_vectors(spark, d)[1], path, "own", "hash", "cosine")
    rows, _ = readers.embedding_cache(spark, path, "own", "hash")
    return rows.select("text", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT 'item' || n_nationkey AS item_id, 'v2' AS kg_version, 'N' || n_nationkey AS node_1, 'in' AS edge, 'R' || n_regionkey AS node_2, 'c_' || n_nationkey AS chunk_id FROM nation""")
def dataset_latest(spark, d):
    """An item per nation with two versions in a store; the later one is read."""
    base = shared_path(spark, "items")
    store = Store(spark, base)
    for r in views.table(spark, d, "nation").collect():  # one file each, 25 nations
        for v, edge in (("v1", "was in"), ("v2", "in")):
            rows = f"node_1,node_2,edge,chunk_id\nN{r.n_nationkey},R{r.n_regionkey},{edge},c_{r.n_nationkey}\n"
            store.save_file(f"item{r.n_nationkey}", "triplets.csv", rows.encode(), f"kg/{v}")
    return readers.dataset_triplets(spark, base).select("item_id", "kg_version", "node_1", "edge", "node_2", F.col("metadata")["chunk_id"].alias("chunk_id"))


@query("""SELECT c_custkey AS id, coalesce(o.s, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def updated_rows(spark, d):
    table = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    changes = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("segment"))
    return writers.updated(table, "id", changes)


@query(f"WITH {SUPPLY} SELECT node_1, edge, node_2, ord AS triplet_ord FROM t WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def triplets_of_chunks(spark, d):
    chunks = views.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("chunk_id"))
    return Triplets(views.supply(spark, d)).of_chunks(chunks).df.select("node_1", "edge", "node_2", "triplet_ord")


@query("SELECT 'C' || c_custkey AS path_id, 'C' || c_custkey || ' -> N' || c_nationkey AS path FROM customer")
def random_walk_one_step(spark, d):
    """A customer's only neighbour is its nation, whatever is drawn."""
    starts = views.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("path_id"), F.concat(F.lit("C"), "c_custkey").alias("start"))
    return paths.RandomWalk(1, seed=5).paths(views.graph(views.geo(spark, d)), starts).select("path_id", cypher.path_text(F.col("path")).alias("path"))


@query("""SELECT 'N' || a.n_nationkey || '>N' || b.n_nationkey AS path_id, 'N' || a.n_nationkey || ' -> R' || a.n_regionkey || ' -> N' || b.n_nationkey AS path
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def randomized_shortest_direct(spark, d):
    """Two nations of a region have one simple path, so the weights drawn don't matter."""
    return paths.RandomizedShortest(0.5, 0, seed=3).paths(views.graph(views.geo(spark, d)), _nation_pairs(spark, d)).select("path_id", cypher.path_text(F.col("path")).alias("path"))


_LIST = "'[' || array_to_string(list_transform(list_sort({}), lambda x: '\"' || x || '\"'), ', ') || ']'"


@query(f"""{_EXTRA}, q AS (SELECT p.path_id, s, e, coalesce((SELECT list(id) FROM x WHERE x.path_id = p.path_id), []) AS extra FROM p)
SELECT path_id, sha256('{{"additional_nodes": ' || {_LIST.format('extra')} || ', "end_node": "' || e || '", "path_nodes": ' || {_LIST.format('[s, e]')} || ', "start_node": "' || s || '"}}') AS subgraph_id FROM q""")
def subgraph_ids(spark, d):
    return _nation_subgraphs(spark, d).with_ids().select("path_id", "subgraph_id")


# items, text, hypotheses


@query("""SELECT doc_id, sha256('doi:10.' || source || '/' || doc_id || CASE WHEN doc_id <> 0 THEN '|pm_id:' || doc_id ELSE '' END) AS id FROM documents""")
def item_ids(spark, d):
    doc = views.table(spark, d, "documents")
    return doc.select("doc_id", ids.item_id(doi=F.concat(F.lit("10."), "source", F.lit("/"), "doc_id"), pm_id=F.col("doc_id")).alias("id"))


@query("""WITH a AS (SELECT doc_id AS rec, 'D' || doc_id AS doi, n_chars AS pm_id FROM documents), b AS (SELECT doc_id AS rec, 'D' || doc_id AS doi, doc_id AS pm_id FROM labels)
SELECT a.rec AS left, b.rec AS right, CAST(a.doi = b.doi AS INTEGER) + CAST(a.pm_id = b.pm_id AS INTEGER) AS matches,
  CAST(a.doi <> b.doi AS INTEGER) + CAST(a.pm_id <> b.pm_id AS INTEGER) AS conflicts FROM a JOIN b ON a.doi = b.doi OR a.pm_id = b.pm_id""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def item_linkage(spark, d):
    a = views.table(spark, d, "documents").select(F.col("doc_id").alias("rec"), F.concat(F.lit("D"), "doc_id").alias("doi"), F.col("n_chars").alias("pm_id"))
    b = views.table(spark, d, "labels").select(F.col("doc_id").alias("rec"), F.concat(F.lit("D"), "doc_id").alias("doi"), F.col("doc_id").alias("pm_id"))
    return records.linked(a, b)


@query("SELECT doc_id AS pm_id, source AS gs_meta, lang AS category FROM documents")
def metadata_aliases(spark, d):
    doc = views.table(spark, d, "documents").select(F.col("doc_id").alias("PMID"), F.col("source").alias("gs_metadata"), F.col("lang").alias("Category"))
    return records.canonical_names(doc)


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda x: trim(x)), lambda x: x <> '') AS c FROM documents)
SELECT CAST(doc_id AS VARCHAR) || '_' || (i - 1) AS chunk_id, CAST(i - 1 AS INTEGER) AS pos, c[i] AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM s)""")
def chunk_sections(spark, d):
    doc = views.table(spark, d, "documents")
    return text.chunk_arrays(doc.select(F.col("doc_id").cast("string").alias("item_id"), text.sections(F.col("text")).alias("chunks"))).select("chunk_id", "pos", "text")


@query()
def chunk_fixed(spark, d):
    return text.chunk_fixed(views.table(spark, d, "documents"), "doc_id", "text", 200, 20)


@query(r"""WITH s AS (SELECT doc_id, string_split_regex(text, '\b') AS c FROM documents), k AS (SELECT doc_id, string_split(text, ' ') AS c FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(c, lambda x, i: (CASE WHEN i > 1 AND regexp_matches(x, '^[.?!]') THEN ltrim(x[2:]) ELSE x END)
  || CASE WHEN i < len(c) THEN regexp_extract(c[i + 1], '^[.?!]') ELSE '' END), '|')) AS repaired FROM k""".replace(r"s AS (SELECT doc_id, string_split_regex(text, '\b') AS c FROM documents), ", ""))
def punctuation_repair(spark, d):
    doc = views.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("c"))
    return doc.select("doc_id", F.md5(F.array_join(text.repair(F.col("c")), "|").cast("binary")).alias("repaired"))


@query("SELECT doc_id, sha256(text) AS hypothesis_id FROM documents")
def hypothesis_ids(spark, d):
    return views.table(spark, d, "documents").select("doc_id", ids.hypothesis_id(F.col("text")).alias("hypothesis_id"))


@query("""WITH r AS (SELECT doc_id, 'Plausible. rating=' || (quality + 2 * toxic) || ' on balance' AS reply FROM labels)
SELECT doc_id, CAST(regexp_extract(reply, 'rating=([0-9]+)', 1) AS INTEGER) AS score, trim(regexp_replace(reply, 'rating=[0-9]+', '', 'g')) AS why FROM r""")
def score_parse(spark, d):
    reply = F.concat(F.lit("Plausible. rating="), F.col("quality") + 2 * F.col("toxic"), F.lit(" on balance"))
    score, why = text.rating(reply)
    return views.table(spark, d, "labels").select("doc_id", score.alias("score"), why.alias("why"))


def _messages(spark, d):
    c = views.table(spark, d, "conversations")
    n = F.size(F.split("text", " "))
    model = F.when(F.col("role") == "user", "gpt-4o-mini-2024").when(F.col("role") == "assistant", "gpt-4o").otherwise("local")
    return c.select(F.col("conv_id").alias("conversation"), model.alias("model"), n.alias("tokens_in"), (n * 2).alias("tokens_out"))


@query("""WITH m AS (SELECT conv_id, role, len(string_split(text, ' ')) AS n FROM conversations)
SELECT conv_id AS conversation, round(sum(CASE role WHEN 'user' THEN round(n / 1000 * 0.00015 + 2 * n / 1000 * 0.0006, 4) WHEN 'assistant' THEN round(n / 1000 * 0.0025 + 2 * n / 1000 * 0.01, 4) ELSE 0 END), 4) AS cost FROM m GROUP BY conv_id""")
def model_cost(spark, d):
    return hypothesis.cost(_messages(spark, d))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links FROM pages")
def page_links(spark, d):
    return readers.html_links(views.table(spark, d, "pages"))


@query("SELECT doc_id, left(text, 20) || chr(10) || chr(10) || '- ' || left(text, 20) AS text FROM documents")
def distilled(spark, d):
    items = views.table(spark, d, "documents").select("doc_id", "text")
    return extraction.distil(items, lambda t: t[:20], lambda s: f"- {s}")


@query("""SELECT CAST(doc_id AS VARCHAR) || '_0' AS chunk_id, 0 AS pos, text FROM documents WHERE text IS NOT NULL""")
def chunk_whole(spark, d):
    items = views.table(spark, d, "documents").select("doc_id", F.col("text").alias("full_text"))
    return text.chunk_arrays(text.chosen_text(items, "full_text", "doc_id")).select("chunk_id", "pos", "text")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'On ' || doc_id ELSE 'Hypothesis for ' || doc_id END AS title, 'S ' || quality AS statement, CAST(toxic AS BIGINT) AS n_references, sha256('S ' || quality) AS hypothesis_id FROM labels""")
def hypothesis_parse(spark, d):
    """Replies with and without a title and references."""
    t = views.table(spark, d, "labels")
    own = F.concat(F.lit("Title: On "), "doc_id", F.lit("\nReferences:\n1. a source\nno source\n"))
    reply = F.concat(F.when(F.col("toxic") == 1, own).otherwise(F.lit("")), F.lit("Hypothesis Statement: S "), "quality")
    found = hypothesis.parsed(t.select(F.col("doc_id").cast("string").alias("subgraph_id"), reply.alias("reply")))
    return found.select(F.col("subgraph_id").cast("long").alias("doc_id"), "title", "statement", F.size("references").cast("long").alias("n_references"), "hypothesis_id")


@query("""SELECT doc_id, least(1.0, greatest(0.0, quality + toxic / 2)) AS score, CASE WHEN quality = 1 THEN 'ACCEPT' ELSE 'REVISE' END AS decision FROM labels""")
def reply_scores(spark, d):
    t = views.table(spark, d, "labels")
    reply = F.concat(F.lit("about "), F.round(F.col("quality") + F.col("toxic") / 2, 1).cast("string"), F.when(F.col("quality") == 1, F.lit(" ACCEPT")).otherwise(F.lit(" no")))
    return t.select("doc_id", text.unit_score(reply).alias("score"), text.decision(reply).alias("decision"))


@query()
def extraction_pipeline(spark, d):
    items = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    return extraction.generate(items, extraction.rule_based)


@query()
def hypothesis_loop(spark, d):
    found, _ = saved(_nation_subgraphs(spark, d).with_ids().join(_nation_subgraphs(spark, d).cypher(), "path_id").select("subgraph_id", F.col("cypher").alias("context")), "ctx")
    shout = lambda x: x.upper()
    verdict = lambda x: "ACCEPT" if "LIVES" in x or len(x) > 400 else "REVISE"
    return hypothesis.improve(found, lambda c: f"Hypothesis Statement: {c}", {"novelty": lambda h: "new", "impact": lambda h: "some"}, verdict, shout)


# streaming


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS relation, count(*) AS n FROM events GROUP BY ALL")
def windowed_relation_counts(spark, d):
    """The streaming aggregation over the table as it is: nothing comes late."""
    counted = incremental.relation_counts(views.table(spark, d, "events"))
    return counted.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "relation", "n")


@query("SELECT event_type AS relation, count(*) AS n FROM events GROUP BY event_type")
def stream_incremental_counts(spark, d):
    return incremental.run_to_table(spark, d, "counts")
