"""Operator 1: exact top-k inner-product search by distributed histogram selection.

Every vector is scored against every query, in blocks.  Rather than sorting scores, each
round counts them in a histogram per query (counted inside the tasks, summed by Spark),
finds the bin that holds the k-th best score and refines that bin, until it is one
integer score wide.  A last scan emits what beats the k-th value; of the rows that
equal it, each task emits only as many smallest ids as are still wanted, which loses
nothing, so a vector that is repeated millions of times stays cheap.

Bounds.  Queries are taken in blocks of at most ``query_block`` rows; one block is what
is collected and broadcast at a time (2,048 x 64 dimensions: 1 MB), and its broadcasts are destroyed after it.  A task holds one
histogram (queries of the block x ``BINS`` counts) and one tile of scores.  Vectors are
never shuffled; a histogram's rows are at most queries x bins per task.  A scan reads only ids and vectors,
and scoring them against a block costs far more than reading them.

Exactness.  Scores are whole numbers: products of doubles while every sum stays below 2**53, of longs
while it stays below 2**62, and of unbounded integers for the rows beyond.

Defined cases.  Vectors that are null, or hold null or non-finite components
take no part, nor do rows with a null id.  Scores compare vectors of equal length
only; empty vectors score 0 with each other.  A pair whose score a long can't hold (beyond 2**63 - 1 either way) isn't ranked, the vectors' other pairs are.  A repeated row counts as often as it occurs as a candidate; a repeated query id
is one query, that of the smallest vector.  Fewer candidates than k: all of them.  Ties go to
the smaller id.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm import common

BINS = 1024
TILE = 1024
#: Marks a pair that isn't ranked: a query's own row, or a score that no long holds.
OWN = -(2**63)


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable rows, components as doubles."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where(ok)


def floored(m: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles, which is exact; infinite only where 256 x exceeds a double."""
    with np.errstate(over="ignore"):
        return np.floor(m * 256)


def whole(x: float) -> int:
    """floor(256 x) without bounds."""
    return int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most TILE rows, all of one length."""
    for batch in batches:
        ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        lengths = np.diff(starts)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for i in range(0, len(rows), TILE):
                part = rows[i : i + TILE]
                yield ids[part], flat[starts[part][:, None] + np.arange(n)]


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of the floored rows of q and m, exact; OWN where no long holds one."""
    a, b = floored(q), floored(m)
    top_a, top_b = np.abs(a).max(initial=0), np.abs(b).max(initial=0)
    width = max(1, m.shape[1])
    if top_a * top_b * width < 2.0**53:
        return (a @ b.T).astype(np.int64)  # exact: every partial sum fits a double
    if top_a < 2.0**62 and top_b < 2.0**62 and top_a * top_b * width < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.full((len(q), len(m)), OWN, dtype=np.int64)
    # rows within this bound have products that fit; the others are multiplied as unbounded integers
    bound = math.isqrt(2**62 // width) - 1
    big_q, big_m = (np.abs(x).max(1, initial=0) > bound for x in (a, b))
    out[np.ix_(~big_q, ~big_m)] = a[~big_q].astype(np.int64) @ b[~big_m].astype(np.int64).T
    exact_m: dict[int, list[int]] = {}
    for i in range(len(q)):
        left = [whole(x) for x in q[i]] if big_q[i] or big_m.any() else None
        for j in range(len(m)) if big_q[i] else np.flatnonzero(big_m):
            j = int(j)
            if j not in exact_m:
                exact_m[j] = [whole(x) for x in m[j]]
            score = sum(x * y for x, y in zip(left, exact_m[j], strict=True))
            if abs(score) < 2**63:
                out[i, j] = score
    return out


class _Block:
    """The queries of one block, grouped by vector length."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (len(r.v), r.id))
        self.ids = np.array([r.id for r in rows], dtype=np.int64)
        self.by_length: dict[int, tuple[int, np.ndarray]] = {}
        start = 0
        for n in sorted({len(r.v) for r in rows}):
            own = [r.v for r in rows if len(r.v) == n]
            m = np.array(own, dtype=np.float64).reshape(len(own), n)
            self.by_length[n] = (start, m)
            start += len(m)

    def scores(self, ids: np.ndarray, m: np.ndarray) -> tuple[int, np.ndarray] | None:
        """First query's number and scores (queries x rows); pairs that aren't ranked hold OWN."""
        if m.shape[1] not in self.by_length:
            return None
        start, q = self.by_length[m.shape[1]]
        s = products(q, m)
        own = self.ids[start : start + len(q)]
        order = np.argsort(own)
        at = np.searchsorted(own[order], ids)
        hit = (at < len(own)) & (own[order[np.minimum(at, len(own) - 1)]] == ids)
        s[order[at[hit]], np.flatnonzero(hit)] = OWN
        return start, s


def _counts(block, state):
    """Rows (q, bin, n) of one task."""

    def run(batches):
        b, (lo, span, width) = block.value, state.value
        total = np.zeros(len(b.ids) * BINS, dtype=np.int64)
        for ids, m in _tiles(batches):
            if (found := b.scores(ids, m)) is None:
                continue
            start, s = found
            n = len(s)
            # unsigned, since the whole range of longs may be spanned; scores below lo wrap beyond it
            off = s.view(np.uint64) - lo[start : start + n, None].view(np.uint64)
            keep = (off < span[start : start + n, None]) & (s != OWN)
            at = (off // width[start : start + n, None]).astype(np.int64)
            keys = (at + (np.arange(start, start + n) * BINS)[:, None])[keep]
            total += np.bincount(keys, minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((full // BINS).astype(np.int32)), pa.array((full % BINS).astype(np.int32)), pa.array(total[full])], ["q", "bin", "n"])

    return run


def _winners(block, state):
    """Rows above the k-th score, and of its equals the smallest ids, as many as are wanted."""

    def run(batches):
        b, (kth, ties) = block.value, state.value
        held: dict[int, np.ndarray] = {}
        for ids, m in _tiles(batches):
            if (found := b.scores(ids, m)) is None:
                continue
            start, s = found
            own = kth[start : start + len(s), None]
            q, r = np.nonzero((s > own) & (s != OWN))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[q + start]), pa.array(ids[r]), pa.array(s[q, r])], ["query_id", "vec_id", "score"])
            q, r = np.nonzero((s == own) & (s != OWN))
            for i in np.unique(q):
                at = start + int(i)
                held[at] = np.sort(np.concatenate([held.get(at, ids[:0]), ids[r[q == i]]]))[: ties[at]]
        for at, best in held.items():
            n = len(best)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.ids[at])), pa.array(best), pa.array(np.full(n, kth[at]))], ["query_id", "vec_id", "score"])

    return run


def _largest(batches):
    top, n = 0.0, 0
    for _, m in _tiles(batches):
        with np.errstate(over="ignore"):
            top, n = max(top, float((floored(m) ** 2).sum(1).max())), n + len(m)
    yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([n])], ["top", "n"])


def _block_result(cands: DataFrame, rows: list, k: int, top: float) -> DataFrame:
    """The rows that can be among the k best of each query of the block, written."""
    sc = cands.sparkSession.sparkContext
    block = _Block(rows)
    n = len(block.ids)
    bound = np.zeros(n, dtype=np.int64)
    for start, m in block.by_length.values():
        with np.errstate(over="ignore", invalid="ignore"):
            reach = np.ceil(np.sqrt((floored(m) ** 2).sum(1)) * np.sqrt(top) * (1 + 1e-9)) + 1
        bound[start : start + len(m)] = [2**63 - 1 if not x < 2.0**62 else int(x) for x in reach]
    shared, sent = sc.broadcast(block), []
    lo, span, need = -bound, 2 * bound.astype(np.uint64) + np.uint64(1), np.full(n, k, dtype=np.int64)
    short = np.zeros(n, dtype=bool)
    while True:
        width = np.maximum(span // np.uint64(BINS) + (span % np.uint64(BINS) > 0), 1).astype(np.uint64)
        sent.append(sc.broadcast((lo, span, width)))
        counted = cands.mapInArrow(_counts(shared, sent[-1]), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("q").orderBy(F.desc("bin"))
        wanted = cands.sparkSession.createDataFrame(pd.DataFrame({"q": np.arange(n, dtype=np.int32), "need": need}))
        seen = counted.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(wanted), "q").where(F.col("upto") - F.col("n") < F.col("need"))
        # at most one row for each query of the block
        hits = seen.groupBy("q").agg(F.min_by(F.struct("bin", F.expr("upto - n as above"), "upto"), "bin").alias("b"), F.first("need").alias("need")).collect()
        found = np.zeros(n, dtype=bool)
        lo, need = lo.copy(), need.copy()
        for h in hits:
            found[h.q] = h.b.upto >= h.need
            lo[h.q] = int(lo[h.q]) + h.b.bin * int(width[h.q])
            need[h.q] -= h.b.above
        short |= ~found
        span = width.copy()
        if (width == 1).all():
            break
    sent.append(sc.broadcast((np.where(short, OWN, lo), np.where(short, 0, need))))
    out = common.written(cands.mapInArrow(_winners(shared, sent[-1]), "query_id long, vec_id long, score long"), "topk")
    for b in (shared, *sent):
        b.destroy()
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``vectors``, its own id left out."""
    spark = vectors.sparkSession
    cands = vectors_of(vectors, id_col, vector_col)
    q = vectors_of(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    shape = cands.mapInArrow(_largest, "top double, n long").agg(F.max("top").alias("top"), F.sum("n").alias("n")).first()
    n = q.count()
    blocks = max(1, -(-n // query_block) * 5 // 4 if n > query_block else 1)
    if blocks > 1:
        q = common.written(q.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition("b"), "queries")
    results = None
    for i in range(blocks if n and shape.n else 0):
        rows = (q.where(F.col("b") == i) if blocks > 1 else q).collect()  # a block: query_block rows or so
        for at in range(0, len(rows), query_block):
            part = _block_result(cands, rows[at : at + query_block], k, shape.top)
            results = part if results is None else results.unionByName(part)
    if results is None:
        results = spark.createDataFrame([], "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
