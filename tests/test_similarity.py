"""Pair and nearest search against brute force, and the bounds on what they send."""

import math

import numpy as np
import pytest

from tessergraph.operators import resolve, similarity

DOUBLES = "id long, vec array<double>"


def sim(a, b, metric):
    a, b = np.array(a), np.array(b)
    if metric == "euclidean":
        return float(1 / (1 + np.sqrt(((a - b) ** 2).sum())))
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) if metric == "dot_product" else (float(a @ b) / n if n > 0 else math.nan)


def rows():
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(90, 6)), 3)
    m[10:14], m[20], m[30], m[40] = m[9], 0, m[9] * 3, m[41] * 1e-3
    return [(int(i) * 3, [float(x) for x in v]) for i, v in enumerate(m)]


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.5), ("euclidean", 0.3), ("dot_product", 2.0), ("cosine", 0.0), ("dot_product", -1.0)])
@pytest.mark.parametrize("tile", [1024, 4])
def test_pairs_and_nearest_by_brute_force(spark, monkeypatch, metric, threshold, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    data = rows()
    df = spark.createDataFrame([*data, (None, [1.0] * 6), (1000, None)], DOUBLES).repartition(3)
    all_pairs = {(a, b): sim(x, y, metric) for a, x in data for b, y in data if a != b}
    got = {(r.a, r.b): r.sim for r in similarity.similar_pairs(df, threshold, metric, block=20).collect()}
    want = {p: s for p, s in all_pairs.items() if p[0] < p[1] and s >= threshold}
    unsure = {p for p, s in all_pairs.items() if abs(s - threshold) < 1e-12}
    assert got.keys() - unsure == want.keys() - unsure and all(abs(s - all_pairs[p]) < 1e-9 for p, s in got.items())
    near = {(r.a, r["rank"]): (r.b, r.sim) for r in similarity.nearest(df, 4, metric, block=20).collect()}
    for a, _ in data:
        best = sorted((-round(s, 9), b) for (x, b), s in all_pairs.items() if x == a and not math.isnan(s))[:4]
        assert [near[a, k + 1][0] for k in range(len(best))] == [b for _, b in best], a


def test_rows_beyond_single_precision_and_repeated_ids(spark):
    data = [(1, [1e200, 1e199]), (2, [1.0, 0.1]), (3, [1e-170, 0.0]), (4, [math.nan, 1.0]), (5, [1e160, 0.0]), (6, [0.9, 0.1]), (6, [1.0, 0.1]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(data, DOUBLES)
    pairs = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.95).collect()}
    assert (2, 6) in pairs and not any(4 in p or 6 == p[0] for p in pairs)
    near = sorted((r["rank"], r.b) for r in similarity.nearest(df, 1).where("a = 6").collect())
    assert near == [(1, 2)]
    big = {(r.a, r.b) for r in similarity.similar_pairs(df, 1e150, "dot_product").collect()}
    assert {(1, 2), (2, 5), (1, 6), (5, 6)} <= big


def test_string_ids_and_short_tables(spark):
    df = spark.createDataFrame([("V10", [1.0, 0.0]), ("V9", [1.0, 0.0]), ("V1", [1.0, 0.0]), ("W", [0.0, 1.0])], "id string, vec array<double>")
    assert [(r.b, r["rank"]) for r in similarity.nearest(df, 2).where("a = 'V9'").orderBy("rank").collect()] == [("V1", 1), ("V10", 2)]
    assert similarity.similar_pairs(df.where("false"), 0.5).collect() == [] == similarity.nearest(df.where("false"), 2).collect()
    with pytest.raises(Exception, match="different lengths"):
        similarity.similar_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], DOUBLES), 0.5).collect()


def test_copies_sent_grow_with_the_rows():
    """Each row used to be sent once for every 1,024 rows there are."""
    assert [similarity._groups(n, similarity.BLOCK) for n in (0, 500, 2000, 100_000, 600_000, 2_000_000)] == [1, 1, 2, 32, 32, 32]
    assert similarity._groups(20_000_000, similarity.BLOCK) == 306


def test_nearest_of_many_rows_is_quick(spark):
    """A row used to cost a sort of each block."""
    import time

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(12_000, 16)))], DOUBLES)
    began = time.time()
    assert similarity.nearest(df, 50).count() == 600_000
    assert time.time() - began < 60
    cache = df.selectExpr("concat('V', id) AS text", "vec").limit(50)
    pairs = similarity.nearest_pairs(cache.withColumnRenamed("text", "id"), 49, 0.3).count()
    assert pairs == similarity.similar_pairs(cache.withColumnRenamed("text", "id"), 0.3).count()
    assert resolve.EmbeddingMerger(cache, 0.3, "ann").k == 50
