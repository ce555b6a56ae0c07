"""The registered breadth-first queries against brute force over every line item."""

from tessergraph.plans import registry


def brute(arcs, start):
    depth, edge = {start: 0}, [start]
    while edge:
        found = []
        for x in edge:
            for y in arcs.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    found.append(y)
        edge = found
    return depth


def test_queries_reach_every_line_item_at_any_depth(spark, tmp_path):
    # a chain S0 - P0 - S1 - P1 ... of 12 suppliers, deeper than 8, with quantities below and above 50
    items = [(k, s, p, 1, float(1 + 49 * (k % 2)), "RAN"[k % 3]) for k, (s, p) in enumerate([(i, i) for i in range(12)] + [(i + 1, i) for i in range(11)] + [(0, 99), (50, 60)])]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    out, both = {}, {}
    for _, s, p, *_ in items:
        out.setdefault(f"S{s}", set()).add(f"P{p}")
        both.setdefault(f"S{s}", set()).add(f"P{p}")
        both.setdefault(f"P{p}", set()).add(f"S{s}")
    for name, arcs in (("bfs_levels_directed", out), ("bfs_levels_undirected", both)):
        got = {r.id: r.depth for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == brute(arcs, "S0"), name
    assert max(got.values()) == 23
