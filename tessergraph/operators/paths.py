"""Traversal: breadth-first levels, shortest, random, guided and model-driven paths.

All operators run many starts at once: the state is a DataFrame with one row per path (or
per path and node), each round is a join with the edges, and rounds are cut by tables in the shared
folder.  Draws come from a hash of seed, path and step, so a path is the same on any number of
partitions and after a lost executor.  Input ``pairs``: (path_id, start[, end]).  Output: the PATH layout.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.functions import vectors
from tessergraph.operators.graph import Graph, pick
from tessergraph.runtime import delete, saved


class PairGenerator(Protocol):
    """Makes a path from start to end for each of pairs (path_id, start, end)."""

    def paths(self, graph: Graph, pairs: DataFrame) -> DataFrame: ...


class StartGenerator(Protocol):
    """Makes a path for each of starts (path_id, start)."""

    def paths(self, graph: Graph, starts: DataFrame) -> DataFrame: ...


def validate(graph: Graph, pairs: DataFrame) -> None:
    """ValueError if a start or end isn't a node of the graph. The nodes are searched by what is asked for, so that they're never sent around for it."""
    for side in ("start", "end"):
        if side in pairs.columns:
            asked = pairs.select(F.col(side).alias("id"))
            found = graph.node_rows().select("id").join(asked.where("id IS NOT NULL").distinct(), "id", "left_semi")
            lost = asked.join(found, "id", "left_anti").limit(3).collect()
            if lost:
                raise ValueError(f"{side} node not in the graph: {', '.join(str(r.id) for r in lost)}")


def arcs(graph: Graph, directed: bool) -> DataFrame:
    """Distinct (id, neighbour) of the domain's edges."""
    e = graph.edge_rows()
    return (e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")) if directed else graph.undirected()).distinct()


def _rounds(limit: int | None) -> Iterator[int]:
    """1, 2, ... to the limit, or without end: searches stop by themselves when nothing new is found."""
    return itertools.count(1) if limit is None else iter(range(1, limit + 1))


def bfs_levels(graph: Graph, starts: DataFrame, directed: bool = True, max_depth: int | None = None) -> DataFrame:
    """(path_id, id, depth) of everything within max_depth of each start; None goes on until nothing new is found."""
    spark = starts.sparkSession
    steps, _ = saved(arcs(graph, directed), "arcs")
    seen, at = saved(starts.select("path_id", F.col("start").alias("id"), F.lit(0).alias("depth")), "bfs")
    tables = [at]
    for depth in _rounds(max_depth):
        edge = seen.where(F.col("depth") == depth - 1)
        new = edge.join(steps, "id").select("path_id", F.col("neighbour").alias("id")).distinct().join(seen.select("path_id", "id"), ["path_id", "id"], "left_anti")
        fresh, fresh_at = saved(new.withColumn("depth", F.lit(depth)), "bfs")
        if fresh.isEmpty():
            delete(spark, fresh_at)
            break
        # a level is a table of its own; nothing that was found is written again, and one scan reads them all, so the plan doesn't grow
        tables.append(fresh_at)
        seen = spark.read.schema(seen.schema).parquet(*tables)
    return seen


def shortest_paths(graph: Graph, pairs: DataFrame, directed: bool = True, max_depth: int | None = None) -> DataFrame:
    """A shortest path for each pair that has one; among equals, the one through the least names from the end backwards.

    Levels keep one parent per node; paths are read back from the ends, a join per hop.
    """
    spark = pairs.sparkSession
    steps, _ = saved(arcs(graph, directed), "arcs")
    want, _ = saved(pairs.select("path_id", "start", "end"), "pairs")
    seen, at = saved(want.select("path_id", F.col("start").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")), "bfs")
    tables = [at]
    ends = want.select("path_id", F.col("end").alias("id"))
    for depth in _rounds(max_depth):
        # a pair whose end has been reached sends nothing more
        reached = seen.join(ends, ["path_id", "id"], "left_semi").select("path_id").distinct()
        edge = seen.where(F.col("depth") == depth - 1).join(reached, "path_id", "left_anti")
        new = edge.select("path_id", F.col("id").alias("parent")).join(steps.select(F.col("id").alias("parent"), F.col("neighbour").alias("id")), "parent")
        new = new.groupBy("path_id", "id").agg(F.min("parent").alias("parent")).join(seen.select("path_id", "id"), ["path_id", "id"], "left_anti")
        fresh, at = saved(new.select("path_id", "id", "parent", F.lit(depth).alias("depth")), "bfs")
        if fresh.isEmpty():
            delete(spark, at)
            break
        tables.append(at)
        seen = spark.read.schema(seen.schema).parquet(*tables)
    back = seen.join(want.select("path_id", F.col("end").alias("id"), "start", "end"), ["path_id", "id"]).select("path_id", "start", "end", F.col("parent").alias("at"), F.array("id").alias("path"), "depth")
    longest = back.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    parents = seen.select("path_id", F.col("id").alias("at"), "parent")
    for _ in range(longest):
        back = back.join(parents, ["path_id", "at"], "left").select("path_id", "start", "end", F.col("parent").alias("at"), F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), F.col("path"))).alias("path"), "depth")
        back, _ = saved(back, "back")
    return back.select("path_id", "start", "end", "path")


class ShortestPath:
    def __init__(self, max_depth: int | None = None):
        self.max_depth = max_depth

    def paths(self, graph: Graph, pairs: DataFrame) -> DataFrame:
        validate(graph, pairs)
        return shortest_paths(graph, pairs, directed=False, max_depth=self.max_depth)


def _multiset(graph: Graph) -> DataFrame:
    """(id, neighbour, way): successors and predecessors, so a pair joined both ways counts twice."""
    ids = graph.node_rows().select(F.col("id").alias("neighbour"))
    e = graph.edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.lit(0).alias("way")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.lit(1).alias("way")))
    return both.join(ids, "neighbour", "left_semi").select("id", "neighbour", "way")


def random_walks(graph: Graph, starts: DataFrame, max_steps: int = 10, seed: int = 0, to_end: bool = False) -> DataFrame:
    """Walks over in- and out-edges of at most max_steps hops; a dead end stops one, and with to_end so does its end."""
    validate(graph, starts)
    steps, _ = saved(_multiset(graph), "steps")
    state = starts.select(*starts.columns, F.array("start").alias("path"))
    for step in range(max_steps):
        at = state.withColumn("id", F.element_at("path", -1))
        going = at.where(F.col("id") != F.col("end")) if to_end else at
        drawn = going.select("path_id", "id").join(steps, "id").groupBy("path_id").agg(F.min_by("neighbour", F.struct(pick(seed + step, "path_id", "neighbour", "way"), "neighbour")).alias("next"))
        state = at.drop("id").join(drawn, "path_id", "left").withColumn("path", F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path"))).drop("next")
        state, _ = saved(state, "walk")
    return state


class RandomWalk:
    """From start to end where pairs have an end: a walk that hasn't arrived may take one more hop to it; others are left out."""

    def __init__(self, max_steps: int = 10, seed: int = 0):
        self.max_steps, self.seed = max_steps, seed

    def paths(self, graph: Graph, pairs: DataFrame) -> DataFrame:
        if "end" not in pairs.columns:
            return random_walks(graph, pairs, self.max_steps, self.seed).withColumn("end", F.element_at("path", -1)).select("path_id", "start", "end", "path")
        walked = random_walks(graph, pairs, self.max_steps, self.seed, to_end=True).withColumn("id", F.element_at("path", -1))
        home = walked.where(F.col("id") == F.col("end"))
        last = graph.undirected().distinct().withColumnRenamed("neighbour", "end")
        saved_by_hop = walked.where(F.col("id") != F.col("end")).join(last, ["id", "end"], "left_semi").withColumn("path", F.concat("path", F.array("end")))
        return home.unionByName(saved_by_hop.select(*home.columns)).select("path_id", "start", "end", "path")


class EmbeddingPath:
    """Depth-first towards the end: of the unvisited neighbours one of the top_k nearest to the end is drawn; a dead end steps back.

    Pairs whose search returns to an exhausted start, or whose path outgrows twice the node count, have no row. Every round visits a node or steps
    back, so the search ends by itself; ``max_rounds`` may end it earlier.
    """

    def __init__(self, embeddings: DataFrame, metric: str = "euclidean", top_k: int = 1, seed: int = 0, max_rounds: int | None = None):
        self.vecs, self.metric, self.top_k, self.seed, self.max_rounds = embeddings.select(F.col("text").alias("id"), "vec"), metric, top_k, seed, max_rounds

    def paths(self, graph: Graph, pairs: DataFrame) -> DataFrame:
        validate(graph, pairs)
        spark = pairs.sparkSession
        steps, _ = saved(arcs(graph, False), "arcs")
        cap = 2 * graph.number_of_nodes()
        wanted = pairs.select(F.col("end").alias("id")).distinct()
        ends, _ = saved(self.vecs.join(wanted, "id", "left_semi").select(F.col("id").alias("end"), F.col("vec").alias("end_vec")), "ends")
        # vectors are larger than Spark takes arrays to be, and all nodes' must not be broadcast
        near = self.vecs.select(F.col("id").alias("neighbour"), F.col("vec").alias("n_vec")).hint("merge")
        state = pairs.select("path_id", "start", "end", F.array("start").alias("path"), F.array("start").alias("visited"))
        arrived = [saved(state.where("start = end").select("path_id", "start", "end", "path"), "arrived")[1]]
        state, state_at = saved(state.where("start <> end"), "guided")
        for round_ in _rounds(self.max_rounds):
            at = state.withColumn("id", F.element_at("path", -1))
            options = at.select("path_id", "end", "id", "visited").join(steps, "id").where(~F.array_contains("visited", F.col("neighbour"))).select("path_id", "end", "neighbour")
            ranked = options.join(near, "neighbour").join(ends, "end").select("path_id", "neighbour", F.round(vectors.distance(F.col("n_vec"), F.col("end_vec"), self.metric), 9).alias("d"))
            w = Window.partitionBy("path_id").orderBy("d", "neighbour")
            top = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= self.top_k)
            drawn = top.groupBy("path_id").agg(F.min_by("neighbour", F.struct(pick(self.seed + round_, "path_id", "neighbour"), "neighbour")).alias("next"))
            moved = at.join(drawn, "path_id", "left")
            back = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
            moved = moved.select(
                "path_id", "start", "end",
                F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(back).alias("path"),
                F.when(F.col("next").isNotNull(), F.array_union("visited", F.array("next"))).otherwise(F.col("visited")).alias("visited"),
            )
            moved, moved_at = saved(moved.where((F.size("path") > 0) & (F.size("path") <= cap)), "guided")
            delete(spark, state_at)
            home, home_at = saved(moved.where(F.element_at("path", -1) == F.col("end")).select("path_id", "start", "end", "path"), "arrived")
            # rounds without arrivals leave no table behind, so the final scan reads only what arrived
            if home.isEmpty():
                delete(spark, home_at)
            else:
                arrived.append(home_at)
            state, state_at = moved.where(F.element_at("path", -1) != F.col("end")), moved_at
            if state.isEmpty():
                break
        return spark.read.schema("path_id string, start string, end string, path array<string>").parquet(*arrived)


class RandomizedShortest:
    """Shortest paths under edge weights 1 + r * U(0, 1) drawn by hash, then detours through random neighbours of the path.

    With r = 0 it is the plain shortest path. Weights are relaxed by rounds of join and minimum until nothing improves.
    """

    def __init__(self, randomness: float = 0.5, waypoints: int = 3, seed: int = 0, max_rounds: int | None = None):
        self.r, self.waypoints, self.seed, self.max_rounds = min(1.0, max(0.0, randomness)), waypoints, seed, max_rounds

    def weighted(self, graph: Graph, pairs: DataFrame) -> DataFrame:
        """A node keeps its cost and parent, not its path; what costs as much as the way to the end found so far is sent no further."""
        spark = pairs.sparkSession
        steps, _ = saved(arcs(graph, False), "arcs")
        cost = 1 + self.r * F.pmod(pick(self.seed, "path_id", "id", "neighbour"), F.lit(1_000_000)) / 1_000_000
        want, _ = saved(pairs.select("path_id", "start", "end"), "pairs")
        best, at = saved(want.select("path_id", F.col("start").alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("fresh")), "relax")
        for _ in _rounds(self.max_rounds):
            bound = best.join(want.select("path_id", F.col("end").alias("id")), ["path_id", "id"]).select("path_id", F.col("cost").alias("bound"))
            live = best.where("fresh").join(bound, "path_id", "left").where("bound IS NULL OR cost < bound")
            sent = live.join(steps, "id").select("path_id", F.col("neighbour").alias("id"), (F.col("cost") + cost).alias("cost"), F.col("id").alias("parent"), F.lit(True).alias("fresh"))
            kept = best.withColumn("fresh", F.lit(False)).unionByName(sent).groupBy("path_id", "id").agg(F.min(F.struct("cost", "fresh", "parent")).alias("b"))
            new, new_at = saved(kept.select("path_id", "id", "b.cost", "b.parent", "b.fresh"), "relax")
            delete(spark, at)
            best, at = new, new_at
            if best.where("fresh").isEmpty():
                break
        parents = best.select("path_id", F.col("id").alias("at"), "parent")
        back = best.join(want.select("path_id", F.col("end").alias("id"), "start", "end"), ["path_id", "id"]).select("path_id", "start", "end", F.col("parent").alias("at"), F.array("id").alias("path"))
        while not back.where("at IS NOT NULL").isEmpty():
            stepped = back.join(parents, ["path_id", "at"], "left").select("path_id", "start", "end", F.col("parent").alias("at"), F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), F.col("path"))).alias("path"))
            back, _ = saved(stepped, "back")
        return back.select("path_id", "start", "end", "path")

    def paths(self, graph: Graph, pairs: DataFrame) -> DataFrame:
        validate(graph, pairs)
        direct, _ = saved(shortest_paths(graph, pairs, directed=False) if self.r == 0 else self.weighted(graph, pairs), "direct")
        if self.r == 0 or not self.waypoints:
            return direct
        around = direct.select("path_id", "path", F.explode("path").alias("id")).join(arcs(graph, False), "id").where(~F.array_contains("path", F.col("neighbour"))).select("path_id", "neighbour").distinct()
        w = Window.partitionBy("path_id").orderBy(pick(self.seed + 1, "path_id", "neighbour"), "neighbour")
        points, _ = saved(around.withColumn("n", F.row_number().over(w)).where(F.col("n") <= self.waypoints), "points")
        tails = direct.select("path_id", "start", "end", F.array("start").alias("path"))
        for n in range(1, self.waypoints + 2):
            goal = points.where(F.col("n") == n).select("path_id", F.col("neighbour").alias("goal")) if n <= self.waypoints else tails.select("path_id", F.col("end").alias("goal"))
            leg_pairs = tails.join(goal, "path_id").select("path_id", F.element_at("path", -1).alias("start"), F.col("goal").alias("end"))
            legs = shortest_paths(graph, leg_pairs, directed=False).select("path_id", F.slice("path", 2, 1_000_000).alias("leg"))
            tails = tails.join(legs, "path_id", "left").select("path_id", "start", "end", F.concat("path", F.coalesce("leg", F.array().cast("array<string>"))).alias("path"))
            tails, _ = saved(tails, "tails")
        # a chain that didn't come home falls back to the direct path
        return tails.join(direct.select("path_id", F.col("path").alias("plain")), "path_id").select("path_id", "start", "end", F.when(F.element_at("path", -1) == F.col("end"), F.col("path")).otherwise(F.col("plain")).alias("path"))


def listing(graph: Graph, fronts: DataFrame, limit: int = 100, seed: int = 0) -> DataFrame:
    """(path_id, src, relation, dst, neighbour, visited): what a walk (path_id, id, path) may choose from.

    At most ``limit`` successors and as many predecessors are drawn; predecessors that are successors too
    show once; each parallel relation is an entry.
    """
    at = fronts.select("path_id", "id", "path")
    succ = graph.successors(at, limit, seed)
    pred = graph.predecessors(at, limit, seed).join(graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")), ["id", "neighbour"], "left_anti")
    out = succ.join(graph.edge_rows().select(F.col("src").alias("id"), "relation", F.col("dst").alias("neighbour")), ["id", "neighbour"]).select("id", "neighbour", F.col("id").alias("src"), "relation", F.col("neighbour").alias("dst"))
    back = pred.join(graph.edge_rows().select(F.col("dst").alias("id"), "relation", F.col("src").alias("neighbour")), ["id", "neighbour"]).select("id", "neighbour", F.col("neighbour").alias("src"), "relation", F.col("id").alias("dst"))
    return at.join(out.unionByName(back), "id").select("path_id", "src", "relation", "dst", "neighbour", F.array_contains("path", F.col("neighbour")).alias("visited"))


def chosen(reply: str | None, names: list[str]) -> str | None:
    """The longest listed name that the reply gives after NEXT_NODE:."""
    m = re.search(r"NEXT_NODE:[ \t]*([^\n]*)", reply or "")
    if not m:
        return None
    fits = [n for n in names if m[1].strip().strip("`'\"").startswith(n)]
    return max(fits, key=len) if fits else None


class ModelWalk:
    """At each step a model is shown the path and the neighbours and names the next node; else a hash draws one, unvisited first."""

    def __init__(self, model: Callable[[str], str], max_steps: int = 10, seed: int = 0, goal: str = "Explore the graph in the most meaningful way", limit: int = 100):
        self.model, self.max_steps, self.seed, self.goal, self.limit = model, max_steps, seed, goal, limit

    def paths(self, graph: Graph, starts: DataFrame) -> DataFrame:
        validate(graph, starts)
        model, goal = self.model, self.goal

        @F.pandas_udf("string")
        def choose(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for path, lines, names in batches:
                out = []
                for p, ls, ns in zip(path, lines, names, strict=True):
                    reply = model(f"{goal}\nPath: {' -> '.join(p)}\nNeighbours:\n" + "\n".join(ls) + "\nAnswer NEXT_NODE: <name>")
                    out.append(chosen(getattr(reply, "content", reply), list(ns)))
                yield pd.Series(out, dtype=object)

        state = starts.select("path_id", "start", F.array("start").alias("path"))
        for step in range(self.max_steps):
            fronts, _ = saved(state.withColumn("id", F.element_at("path", -1)), "fronts")
            options = listing(graph, fronts, self.limit, self.seed + step)
            # a node whose only neighbour is itself is a dead end
            entry = F.concat(F.when(F.col("visited"), F.lit("visited: ")).otherwise(F.lit("")), "src", F.lit(" -["), "relation", F.lit("]-> "), "dst")
            draw = F.struct("visited", pick(self.seed + step, "path_id", "neighbour"), "neighbour")
            grouped = options.groupBy("path_id").agg(F.array_sort(F.collect_list(entry)).alias("lines"), F.array_sort(F.collect_set("neighbour")).alias("names"), F.min_by("neighbour", draw).alias("fallback"))
            live = fronts.join(grouped, "path_id").where(~((F.size("names") == 1) & (F.get("names", F.lit(0)) == F.col("id"))))
            moved = live.select("path_id", F.coalesce(choose("path", "lines", "names"), "fallback").alias("next"))
            state = fronts.drop("id").join(moved, "path_id", "left").select("path_id", "start", F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"))
            state, _ = saved(state, "told")
        return state.select("path_id", "start", F.element_at("path", -1).alias("end"), "path")


# edges along paths


def hops(paths: DataFrame) -> DataFrame:
    """(path_id, pos, a, b) of consecutive nodes."""
    w = F.transform(F.slice("path", 1, F.size("path") - 1), lambda x, i: F.struct(i.alias("pos"), x.alias("a"), F.get("path", i + 1).alias("b")))
    return paths.where(F.size("path") > 1).select("path_id", F.explode(w).alias("h")).select("path_id", "h.pos", "h.a", "h.b")


def path_edges(graph: Graph, paths: DataFrame) -> DataFrame:
    """(path_id, pos, src, relation, dst): per hop every forward relation, or if there is none every reverse one, as stored."""
    h, e = hops(paths), graph.edge_rows().select("src", "relation", "dst")
    ahead = h.join(e.select(F.col("src").alias("a"), "relation", F.col("dst").alias("b")), ["a", "b"]).select("path_id", "pos", F.col("a").alias("src"), "relation", F.col("b").alias("dst"))
    lost = h.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    behind = lost.join(e.select(F.col("dst").alias("a"), "relation", F.col("src").alias("b")), ["a", "b"]).select("path_id", "pos", F.col("b").alias("src"), "relation", F.col("a").alias("dst"))
    return ahead.unionByName(behind)


def path_edges_last(graph: Graph, paths: DataFrame) -> DataFrame:
    """(path_id, pos, source, target, relation): one row per hop in path direction, with the last relation, '' without any."""
    e = graph.edge_rows()
    last = e.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.max_by("relation", F.struct("ord", "relation")).alias("f"))
    back = e.groupBy(F.col("dst").alias("a"), F.col("src").alias("b")).agg(F.max_by("relation", F.struct("ord", "relation")).alias("r"))
    return hops(paths).join(last, ["a", "b"], "left").join(back, ["a", "b"], "left").select("path_id", "pos", F.col("a").alias("source"), F.col("b").alias("target"), F.coalesce("f", "r", F.lit("")).alias("relation"))


def walk_edges(graph: Graph, paths: DataFrame) -> DataFrame:
    """(path_id, pos, source, relation, target) in walking direction: reverse edges as REVERSE_<relation>, missing ones unknown_relation."""
    e = graph.edge_rows()
    fwd = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("f"))
    rev = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.concat(F.lit("REVERSE_"), "relation").alias("r"))
    h = hops(paths)
    ahead = h.join(fwd, ["a", "b"]).select("path_id", "pos", F.col("a").alias("source"), F.col("f").alias("relation"), F.col("b").alias("target"))
    lost = h.join(fwd.select("a", "b").distinct(), ["a", "b"], "left_anti").join(rev, ["a", "b"], "left")
    return ahead.unionByName(lost.select("path_id", "pos", F.col("a").alias("source"), F.coalesce("r", F.lit("unknown_relation")).alias("relation"), F.col("b").alias("target")))
