"""Embeddings: cache-through look-up, threshold pairs, nearest neighbours.

Exact pair search compares groups of rows rather than rows with rows: a task multiplies the matrices of two
groups, tile by tile, so n rows cost n*n multiplications but no n*n rows are formed, and only pairs that pass are
emitted. Up to SPREAD times GROUP rows (2 million) each row is sent to at most SPREAD tasks, so what is shuffled grows with
the rows; beyond that groups keep their size and grow in number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.functions import vectors

#: Rows of a group, at least while there are few groups; most groups while they are small; rows of a group that more groups follow.
BLOCK, SPREAD, GROUP = 1024, 32, 65_536
#: Rows packed in one; rows of a tile; pairs measured at once.
PACK, TILE, CHECKED = 512, 1024, 1 << 16


def embed(texts: DataFrame, model: Callable[[list[str]], list], batch: int = 100, retries: int = 5) -> DataFrame:
    """(text, vec): the model is called with at most ``batch`` texts at a time and asked again when it fails or miscounts."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(0, len(pdf), batch):
                part = pdf.text.iloc[i : i + batch].tolist()
                for attempt in range(retries):
                    try:
                        got = model(part)
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                        break
                    except Exception:
                        if attempt == retries - 1:
                            raise
                yield pd.DataFrame({"text": part, "vec": [[float(x) for x in v] for v in got]})

    return texts.select("text").where("text IS NOT NULL").distinct().mapInPandas(run, "text string, vec array<double>")


def cached(texts: DataFrame, cache: DataFrame, model: Callable | None = None) -> DataFrame:
    """Vectors from the cache; the model (or, without one, hashing) makes only those it lacks."""
    own = texts.select("text").where("text IS NOT NULL").distinct()
    fresh = own.join(cache, "text", "left_anti")
    made = embed(fresh, model) if model else fresh.select("text", vectors.hashed(F.col("text")).alias("vec"))
    return cache.join(own, "text", "left_semi").select("text", "vec").unionByName(made)


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The similarity of row i of a and row i of b; NaN where a cosine has none."""
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(((a - b) ** 2).sum(1)))
    s = np.einsum("ij,ij->i", a, b)
    if metric == "cosine":
        n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        s = np.divide(s, n, out=np.full_like(s, np.nan), where=n > 0)
    return s


def _groups(n: int, block: int) -> int:
    """Into how many groups n rows are dealt: of about ``block`` rows, but no more than SPREAD until a group has GROUP rows, so what is copied stays in proportion to the rows."""
    return max(1, min(SPREAD, math.ceil(n / block)), math.ceil(n / GROUP))


def _packed(rows: DataFrame, groups: int) -> DataFrame:
    """(g, n, width, ids, vecs): rows dealt by a hash of the id, packed by up to PACK; components of 4 bytes where those hold them exactly."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, g = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            if not len(g):
                continue
            lengths = np.unique(vecs.value_lengths().to_numpy())
            if len(lengths) > 1:
                raise ValueError("vectors of different lengths")
            m = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(g), int(lengths[0]))
            order = np.argsort(g, kind="stable")
            cuts = [x for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g[order])) + 1) for x in np.split(part, range(PACK, len(part), PACK))]
            out = []
            for cut in cuts:
                own = order[cut]
                v = m[own]
                with np.errstate(over="ignore", invalid="ignore"):
                    low = v.astype(np.float32)
                short = bool((low == v).all())
                held = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(own)))
                out.append((int(g[own[0]]), len(own), 4 if short else 8, held, (low if short else v).tobytes()))
            gs, ns, widths, held, packed = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int32()), pa.array(ns, pa.int32()), pa.array(widths, pa.int32()), pa.concat_arrays(held), pa.array(packed, pa.binary())], ["g", "n", "width", "ids", "vecs"])

    return dealt.mapInArrow(run, f"g int, n int, width int, ids array<{kind}>, vecs binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(the row's numbers, ids, vectors as doubles) of packed rows."""
    at = {name: k for k, name in enumerate(batch.schema.names)}
    for r in range(batch.num_rows):
        numbers = {name: batch.column(k)[r].as_py() for name, k in at.items() if name not in ("ids", "vecs")}
        ids = batch.column(at["ids"])[r].values.to_numpy(zero_copy_only=False)
        if ids.dtype == object and not any(isinstance(x, str) and x.endswith("\0") for x in ids):
            ids = np.array(ids.tolist())  # fixed-width strings compare by code point, as Spark's do
        flat = np.frombuffer(batch.column(at["vecs"])[r].as_buffer(), dtype=np.float32 if numbers["width"] == 4 else np.float64)
        yield numbers, ids, flat.reshape(numbers["n"], -1 if len(flat) else 0).astype(np.float64)


class _Side:
    """Rows of one side of a comparison: ``u`` are single-precision rows of norm at most 1, ``scale`` times whose products are what the metric orders by.

    ``u`` is None for rows whose numbers are too large or small for that, which are measured in doubles with all others.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, f: np.ndarray, norms: np.ndarray, metric: str, plain: bool):
        self.ids, self.m, self.u, self.scale = ids, m, None, 1.0
        if plain:
            if metric != "cosine":
                self.scale = max(float(norms.max(initial=0)), 1e-140)
            self.u = (f / (norms[:, None] if metric == "cosine" else self.scale)).astype(np.float32)


def _sides(parts: list[tuple[np.ndarray, np.ndarray]], metric: str, right: bool = False) -> list[_Side]:
    """The rows as one side, and a second one of those that single precision can't hold. Rows that have no similarity with any are left out."""
    if len({m.shape[1] for _, m in parts}) > 1:
        raise ValueError("vectors of different lengths")
    ids, m = np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts])
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (m**2).sum(1)
        keep = ~np.isnan(m).any(1) & ~((squares == 0) & (metric == "cosine"))
        ids, m, squares = ids[keep], m[keep], squares[keep]
        f = m
        if metric == "euclidean":  # -d*d/2 = ab - aa/2 - bb/2, as one product
            half, one = -squares[:, None] / 2, np.ones((len(m), 1))
            f = np.hstack([m, one, half] if right else [m, half, one])
        norms = np.sqrt((f**2).sum(1))
    plain = norms < 1e140
    if metric == "cosine":
        plain &= norms > 1e-140
    return [_Side(ids[x], m[x], f[x], norms[x], metric, b) for x, b in ((plain, True), (~plain, False)) if x.any()]


def _same_length(sides: list[_Side]) -> None:
    if len({s.m.shape[1] for s in sides}) > 1:
        raise ValueError("vectors of different lengths")


def _near(left: _Side, right: _Side, x: slice, y: slice) -> np.ndarray | None:
    """Products of two tiles in single precision, each within _slack() of the true one; None where numbers are too large or small for it."""
    return None if left.u is None or right.u is None else left.u[x] @ right.u[y].T


def _slack(side: _Side) -> float:
    return (side.u.shape[1] + 8) * 2.0**-22


def _floor(threshold: float, metric: str) -> float:
    """The least product that can reach the threshold."""
    if metric != "euclidean":
        return threshold
    return -math.inf if threshold <= 0 else -(max(1 / threshold - 1, 0) ** 2) / 2


def similar_pairs(rows: DataFrame, threshold: float, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(a, b, sim), a < b, of all pairs of rows (id, vec) with at least the threshold.

    A task compares two groups of rows, tile by tile: single-precision products leave the pairs that may pass, which are then measured in doubles.
    """
    vectors._known(metric)
    rows = rows.where("id IS NOT NULL AND vec IS NOT NULL")
    groups = _groups(rows.count(), block)
    # a pair of groups (i, j) gets the rows of both: ``groups`` copies of each row, never a pair of rows
    spread = _packed(rows, groups).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other"))
    keyed = spread.select("g", "n", "width", "ids", "vecs", F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"))
    task = (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int")

    def tiles(left: _Side, right: _Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in range(0, len(left.ids), TILE):
            for q in range(p if same else 0, len(right.ids), TILE):
                s = _near(left, right, slice(p, p + TILE), slice(q, q + TILE))
                if s is None:
                    x, y = (v.ravel() for v in np.indices((len(left.ids[p : p + TILE]), len(right.ids[q : q + TILE]))))
                else:
                    least = _floor(threshold, metric) / (left.scale * right.scale)
                    hits = np.flatnonzero(s.ravel() >= np.float32(least - abs(least) * 2.0**-22 - _slack(left)))
                    x, y = hits // s.shape[1], hits % s.shape[1]
                x, y = x + p, y + q
                if same:
                    x, y = x[x < y], y[x < y]
                for k in range(0, len(x), CHECKED):
                    yield x[k : k + CHECKED], y[k : k + CHECKED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], dict[int, list]] = {}
        for batch in batches:
            for r, ids, m in _unpacked(batch):
                found.setdefault((r["i"], r["j"]), {}).setdefault(r["g"], []).append((ids, m))
        for (i, j), sides in found.items():
            if i not in sides or j not in sides:
                continue
            lefts, rights = _sides(sides[i], metric), _sides(sides[j], metric, True)
            _same_length([*lefts, *rights])
            both = [(x, y) for p, x in enumerate(lefts) for q, y in enumerate(rights) if i != j or p <= q]
            for left, right, x, y in ((left, right, x, y) for left, right in both for x, y in tiles(left, right, i == j and (left.u is None) == (right.u is None))):
                with np.errstate(over="ignore", invalid="ignore"):
                    s = _exact(left.m[x], right.m[y], metric)
                    good = (s >= threshold) & (left.ids[x] != right.ids[y])
                if good.any():
                    a, b, s = left.ids[x[good]], right.ids[y[good]], s[good]
                    low = (a < b).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(low, a, b)), pa.array(np.where(low, b, a)), pa.array(s)], ["a", "b", "sim"])

    kind = rows.schema["id"].dataType.simpleString()
    return keyed.repartitionById(groups * (groups + 1) // 2, task).mapInArrow(run, f"a {kind}, b {kind}, sim double")


class _Best:
    """The k best of some rows so far: candidates are kept aside and merged now and then, which raises what is asked of further ones."""

    def __init__(self, left: _Side, at: slice, k: int, metric: str, by: str):
        self.left, self.at, self.k, self.metric, self.by = left, at, k, metric, by
        self.n = len(left.ids[at])
        # a row isn't its own neighbour, nor is any row with its id
        self.own = int(np.unique(left.ids[at], return_counts=True)[1].max())
        self.kept: list[tuple] = []
        self.fresh, self.least = 0, np.full(self.n, -np.inf)

    def see(self, right: _Side, y: slice) -> None:
        s = _near(self.left, right, self.at, y)
        n_right = len(right.ids[y])
        if s is None:
            hits = np.arange(self.n * n_right)
        else:
            slack = _slack(self.left)
            least = self.least / (self.left.scale * right.scale)
            least = least - np.where(np.isfinite(least), np.abs(least), 0) * 2.0**-22 - slack
            if n_right > self.k + self.own and not np.isfinite(self.least).all():
                # of this tile alone k others (besides rows of its id) are at least so near
                alone = np.partition(s, n_right - self.k - self.own, axis=1)[:, n_right - self.k - self.own].astype(np.float64) - 2 * slack - 2e-9 / (self.left.scale * right.scale) * self.reach(right)
                least = np.where(np.isfinite(self.least), least, alone)
            hits = np.flatnonzero((s >= least.astype(np.float32)[:, None]).ravel())
        for c in range(0, len(hits), CHECKED):
            x, j = hits[c : c + CHECKED] // n_right, hits[c : c + CHECKED] % n_right
            a, b = self.left.m[self.at][x], right.m[y][j]
            with np.errstate(over="ignore", invalid="ignore"):
                raw = _exact(a, b, self.metric)
                sim = np.round(raw, 9)
                good = np.isfinite(sim) & (self.left.ids[self.at][x] != right.ids[y][j])
                score = raw if self.by == self.metric else _exact(a, b, self.by)
            self.kept.append((x[good], right.ids[y][j[good]], sim[good], score[good]))
            self.fresh += int(good.sum())
            if self.fresh > max(4 * CHECKED, self.n * self.k):
                self.merge()
        if self.fresh > self.n * self.k or not np.isfinite(self.least).all():
            self.merge()

    def reach(self, right: _Side) -> float:
        """How far products may differ whose rounded similarities are a step apart, for a step of 1."""
        return 1.0 if self.metric != "euclidean" else (1 + math.sqrt(2 * self.left.scale * right.scale) * 2) ** 3

    def merge(self) -> None:
        if not self.kept:
            return
        x, ids, sim, score = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        order = np.lexsort((ids, -sim, x))
        x = x[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        good = rank < self.k
        order, x = order[good], x[good]
        self.kept, self.fresh = [(x, ids[order], sim[order], score[order])], 0
        last = rank[good] == self.k - 1
        # a similarity that rounds to the k-th is a tie, which goes by id
        kth = sim[order][last] - 1e-9
        self.least[x[last]] = kth if self.metric != "euclidean" else [_floor(t, self.metric) for t in kth]


def nearest(rows: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(a, b, sim, rank): each row's k nearest others, exactly; similarities are rounded to nine places, ties go to the smaller id.

    A task has one group of rows and sees all others pass by, so it finds the k best of its rows itself.
    """
    return _nearest(rows, k, metric, block).select("a", "b", "sim", "rank")


def nearest_pairs(rows: DataFrame, k: int, threshold: float, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of at least the threshold of which one is among the k nearest of the other (by cosine, for dot products)."""
    near = _nearest(rows, k, "euclidean" if metric == "euclidean" else "cosine", block, threshold, metric)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _nearest(rows: DataFrame, k: int, metric: str, block: int, threshold: float | None = None, by: str | None = None) -> DataFrame:
    """The nearest, and of these only pairs of at least the threshold by the metric ``by``, if one is given."""
    vectors._known(metric)
    rows = rows.where("id IS NOT NULL AND vec IS NOT NULL")
    groups = _groups(rows.count(), block)
    spread = _packed(rows, groups).select("g", "n", "width", "ids", "vecs", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("task"))
    if k < 1:
        spread = spread.where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best, some, held, task = [], None, [], 0, None

        def see() -> None:
            rights = _sides(some, metric, True)
            _same_length([*(b.left for b in best[:1]), *rights])
            for right in rights:
                for y in range(0, len(right.ids), 2 * TILE):
                    for b in best:
                        b.see(right, slice(y, y + 2 * TILE))

        def ready() -> list[_Best]:
            return [_Best(left, slice(p, p + TILE // 2), k, metric, by or metric) for left in _sides(own, metric) for p in range(0, len(left.ids), TILE // 2)]

        # a task's own rows come first
        for batch in batches:
            for r, ids, m in _unpacked(batch):
                task = r["task"]
                if r["g"] == task:
                    own.append((ids, m))
                    continue
                if not own:
                    return
                if best is None:
                    best = ready()
                some.append((ids, m))
                held += len(ids)
                if held >= 4 * TILE:
                    see()
                    some, held = [], 0
        if not own:
            return
        best = ready() if best is None else best
        for part in [*([some] if some else []), *(own[x : x + 8] for x in range(0, len(own), 8))]:
            some = part
            see()
        found = []
        for b in best:
            b.merge()
            found += [(b.left.ids[b.at][x], ids, sim, score) for x, ids, sim, score in b.kept]
        if not found:
            return
        a, ids, sim, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((ids, -sim, a))  # rows of one id are ranked together
        a, ids, sim, score = a[order], ids[order], sim[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a) + 1
        good = rank <= k
        if threshold is not None:
            good &= score >= threshold
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(ids[good]), pa.array(sim[good]), pa.array(rank[good].astype(np.int32))], ["a", "b", "sim", "rank"])

    kind = rows.schema["id"].dataType.simpleString()
    return spread.repartitionById(groups, F.col("task")).sortWithinPartitions(F.col("g") != F.col("task")).mapInArrow(run, f"a {kind}, b {kind}, sim double, rank int")


def top_matches(rows: DataFrame, query: list[float], k: int = 5, metric: str = "cosine") -> DataFrame:
    """The k rows nearest to one vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("*", vectors.distance(F.col("vec"), q, metric).alias("distance")).where("distance IS NOT NULL").orderBy("distance", "id").limit(k)
