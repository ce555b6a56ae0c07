"""Operator 10: variable-capacity best-fit packing.

Documents are packed whole into bins of one of several permitted sequence lengths; a document longer than the
largest is first cut into pieces of that length and a rest.  Pieces are taken by falling
length.  A piece goes to the open bin with the least room that still holds it (best fit).  If none
does, a bin is opened of the permitted length with the least cost per token it can
expect to hold: its ``cost`` over the piece plus what of the rest of the corpus, shorter
pieces, can still fill the bin.  In the end each bin shrinks to the smallest permitted
length that holds its contents.

Scale.  Equal lengths are interchangeable, so best fit runs on the length histogram, at
most ``max(capacities)`` entries whatever the corpus, and handles all bins of one state at
once: a group of bins with equal contents.  Each step spends a length or changes a whole
group, so the plan is bounded by the lengths too.  It runs on the driver over those counts, never
over documents.  A piece finds its bin by its rank among the pieces of its length: ranks are
counted per (length, bucket) first, so a length held by a third of all rows
spreads over buckets, and the bounded plan is looked up by binary search in the tasks.

Length: tokens of op9's byte-level vocabulary plus one for the end-of-document mark (``pack_tokens``, which the query and the
pipeline use), or UTF-8 bytes plus one, or any column given as ``length_col`` (``pack``).  Tokens are cut only between
characters, so a piece can have up to 3 tokens less than the largest length; with ``carry`` each piece has its own text, and a document's pieces in order are its text.

Defined cases.  Null and empty texts have length 1, the mark.  Rows with a null id, and repeated rows, are packed as
pieces of their own; a stored draw parts equal rows, so they don't meet in one bucket.  An empty table gives an empty result.  Lengths below 1 in a given column count as 1, null
lengths too.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessergraph.llm import common, lengths

CAPACITIES = (2048, 8192, 32_768)


def default_cost(capacity: int) -> float:
    """Tokens of a sequence, 16 for its handling, and attention in blocks of 1,024, charged at 1/32."""
    return capacity + 16 + capacity * capacity / 1024 / 32


class Plan:
    """Best fit over a length histogram. Intervals: of each length, ranks lo.. go to bins first.., q in each, at an offset."""

    def __init__(self, histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost):
        self.capacities = tuple(sorted(capacities))
        self.lengths: list[int] = []
        self.ranks: list[int] = []
        self.first: list[int] = []
        self.per_bin: list[int] = []
        self.offset: list[int] = []
        self.bins = 0
        #: (first bin, contents) of runs of bins with equal contents
        self.runs: list[tuple[int, int, int]] = []
        # open groups by room: room -> list of (first bin, bins, used)
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int, int]]] = {}

        def put(room: int, group: tuple[int, int, int]) -> None:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append(group)

        def take(room: int) -> tuple[int, int, int]:
            g = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(bisect.bisect_left(rooms, room))
            return g

        left = sorted(histogram.items(), reverse=True)
        shorter = np.array([n * c for n, c in left][::-1], dtype=object)
        below = [0, *np.cumsum(shorter)] if len(left) else [0]  # tokens of the i shortest lengths
        ascending = [n for n, _ in left][::-1]
        for k, (n, count) in enumerate(left):
            rank = 0
            while rank < count:
                i = bisect.bisect_left(rooms, n)
                if i == len(rooms):
                    size = self._opened(n, count - rank, below, ascending, len(left) - 1 - k, cost)
                    q = size // n
                    many = -(-(count - rank) // q)
                    put(size, (self.bins, many, 0))
                    self.bins += many
                    continue
                room = rooms[i]
                first, many, used = take(room)
                q = room // n
                full = min(many, (count - rank) // q)
                if full:
                    self._place(n, rank, first, q, used)
                    rank += full * q
                    put(room - q * n, (first, full, used + q * n))
                rest = count - rank
                if full < many and rest:  # fewer than q are left: one bin gets them all
                    self._place(n, rank, first + full, rest, used)
                    rank = count
                    put(room - rest * n, (first + full, 1, used + rest * n))
                    full += 1
                if full < many:
                    put(room, (first + full, many - full, used))
        #: (room, bins) as opened, before bins shrink
        self.spare = sorted((room, m) for room, gs in groups.items() for _, m, _ in gs)
        self.runs = sorted((f, m, u) for gs in groups.values() for f, m, u in gs)
        order = np.lexsort((np.array(self.ranks, dtype=np.int64), np.array(self.lengths, dtype=np.int64)))
        as_array = lambda x: np.array(x, dtype=np.int64)[order]
        self.table = tuple(map(as_array, (self.lengths, self.ranks, self.first, self.per_bin, self.offset)))

    def _place(self, n: int, rank: int, first: int, q: int, used: int) -> None:
        for x, v in ((self.lengths, n), (self.ranks, rank), (self.first, first), (self.per_bin, q), (self.offset, used)):
            x.append(v)

    def _opened(self, n: int, count: int, below: list, ascending: list[int], shorter: int, cost) -> int:
        """The permitted length with the least cost per token that its bins can expect to hold."""
        best = None
        for c in self.capacities:
            if c < n:
                continue
            q = c // n
            bins = -(-count // q)
            room = c * bins - count * n
            fill = min(room, below[min(shorter, bisect.bisect_right(ascending, c - n))])
            price = cost(c) * bins / (count * n + fill)
            if best is None or price < best[0]:
                best = price, c
        return best[1]

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """First bin of each run and its final, shrunk capacity."""
        first = np.array([f for f, _, _ in self.runs], dtype=np.int64)
        caps = np.array(self.capacities, dtype=np.int64)
        return first, caps[np.searchsorted(caps, np.array([u for _, _, u in self.runs], dtype=np.int64))]


PIECES = "doc_id long, piece int, start long, n_tokens long"


def _assign(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (lengths, ranks, first, per_bin, offset), (runs, caps) = shared.value
        # one sorted key: where each length begins, then its ranks
        starts = np.searchsorted(lengths, np.arange(lengths[-1] + 2)) if len(lengths) else np.zeros(1, dtype=np.int64)
        for b in batches:
            n, r = (b.column(x).to_numpy(zero_copy_only=False) for x in ("n_tokens", "rank"))
            lo, hi = starts[n], starts[n + 1]
            while (lo + 1 < hi).any():  # binary search within each length, all rows at once
                mid = (lo + hi) // 2
                right = ranks[np.minimum(mid, len(ranks) - 1)] <= r
                lo, hi = np.where(right & (lo + 1 < hi), mid, lo), np.where(~right & (lo + 1 < hi), mid, hi)
            k = r - ranks[lo]
            bin_id = first[lo] + k // per_bin[lo]
            at = offset[lo] + (k % per_bin[lo]) * n
            size = caps[np.searchsorted(runs, bin_id, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *map(pa.array, (bin_id, at, size))], [*names, "bin_id", "bin_offset", "capacity"])

    return run


def placed(pieces: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> DataFrame:
    """The pieces (PIECES and what else they carry) with bin, place in the bin and the bin's final capacity."""
    spark, names = pieces.sparkSession, pieces.columns
    held = common.written(pieces.withColumn("salt", F.floor(F.rand(10) * 65_536)), "pieces")
    histogram = {r.n_tokens: r.n for r in held.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most max(capacities) rows
    plan = Plan(histogram, capacities, cost)
    shared = spark.sparkContext.broadcast((plan.table, plan.sizes()))
    buckets = max(1, math.isqrt(sum(histogram.values())))
    held = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)))
    counts = held.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece", "salt")
    ranked = held.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "bucket"])
    out = T.StructType([*pieces.schema.fields, *(T.StructField(x, T.LongType()) for x in ("bin_id", "bin_offset", "capacity"))])
    return ranked.select(*names, (F.col("nth") + F.col("before")).cast("long").alias("rank")).mapInArrow(_assign(shared, names), out)


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """One row per piece: its document, place in the document, bin, place in the bin and the bin's final capacity; lengths in bytes or as given."""
    top = max(capacities)
    length = F.col(length_col) if length_col else F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + 1
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(1)), F.lit(1)).alias("length"))
    pieces = whole.select("doc_id", "length", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length - 1) div {top} as int)"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("length") - F.col("piece").cast("long") * top).cast("long").alias("n_tokens"))
    return placed(pieces, capacities, cost)


def cut(tokens: list[bytes], top: int) -> list[tuple[int, int]]:
    """(start, tokens) of the pieces of a document: the mark counts in the last, and no piece begins within a character."""
    out, at, n = [], 0, len(tokens)
    while n - at + 1 > top:
        end = min(at + top, n)
        inside = end
        while inside > at + 1 and inside < n and tokens[inside][0] & 0xC0 == 0x80:
            inside -= 1
        if inside < n and tokens[inside][0] & 0xC0 != 0x80:
            end = inside
        out.append((at, end - at))
        at = end
    return [*out, (at, n - at + 1)]


def _cut_texts(ranks: bytes, top: int, kind: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = lengths.encoder(ranks)
        show = enc.library.decode_single_token_bytes
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                ids = enc.tokens(t) if t else []
                if len(ids) < top:
                    rows.append((doc_id, 0, 0, len(ids) + 1, t))
                    continue
                tokens = list(map(show, ids))
                for k, (at, n) in enumerate(cut(tokens, top)):
                    rows.append((doc_id, k, at, n, b"".join(tokens[at : at + n]).decode("utf-8", "replace")))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(made[: len(kind)], kind.names)

    return run


def token_pieces(docs: DataFrame, top: int, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, ranks_path: str = lengths.RANKS) -> DataFrame:
    """PIECES of at most ``top`` tokens, with ``carry`` and their texts."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    kind = T.StructType.fromDDL(PIECES + (", text string" if carry else ""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_cut_texts(ranks, top, kind), kind)


def pack_tokens(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = default_cost, carry: bool = False, **columns: str) -> DataFrame:
    """One row per piece, as ``pack``, its length and places in tokens; with ``carry`` and its text."""
    return placed(token_pieces(docs, max(capacities), carry=carry, **columns), capacities, cost)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
