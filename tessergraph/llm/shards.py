"""Operator 6: minimax contiguous sharding of atomic groups.

Equal texts form a group, which is never cut.  Groups are ordered by the SHA-256 of the text
and cut into contiguous shards so that the largest shard is as small as it can be: a
binary search over the capacity, each capacity checked greedily (fill a shard until the
next group doesn't fit, then open the next).  The smallest feasible capacity bounds every shard; among the
cuts it allows, those are taken that come nearest to equal shares of what isn't in oversized groups, so
one huge group doesn't leave the other shards empty.

Scale.  The driver never sees the groups.  It holds sizes by hash prefix (65,536
prefixes at first).  A greedy run over prefixes gives bounds on where each cut falls: taking prefixes as
divisible shows a capacity infeasible, taking them whole shows it feasible.  Only when neither
decides, the prefixes in which cuts can fall are replaced by finer ones, or, once they hold at most
``FETCH`` groups in all, by the groups themselves.  So what the driver holds follows shards
and prefixes, not documents, and the answer is exact.

Slots number a shard's rows without gaps.  Rows are spread over buckets by a hash of id, text and a stored draw, so that equal rows part too;
bucket counts are summed per shard, and rows are numbered within their bucket, so neither a
shard nor a group of copies meets in one task.

Law: ``bytes`` (sizes near equal; one group larger than the mean shard can make it
impossible to be nearer than that group).  Size: UTF-8 bytes of the text plus 16.

Defined cases.  A null text is one group, of size 16, apart from no other: it equals the empty text's size and
group.  Repeated rows and null ids are rows of their own, with own slots.  Fewer groups
than shards: the last shards stay empty.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessergraph.llm import common

PREFIX = 4
FETCH = 200_000
OVERHEAD = 16


class Ordered:
    """Sizes in hash order: (first hash or prefix, size, groups, atomic)."""

    def __init__(self, rows: list[tuple[str, int, int, bool]]):
        self.rows = sorted(rows)
        self.total = sum(r[1] for r in self.rows)

    def greedy(self, capacity: int, shards: int) -> list[str] | None:
        """Cuts of a greedy run that takes every entry whole; None if it needs more shards."""
        cuts, filled = [], 0
        for key, size, _, _ in self.rows:
            if size > capacity:
                return None
            if filled + size > capacity:
                cuts.append(key)
                filled = 0
                if len(cuts) >= shards:
                    return None
            filled += size
        return cuts

    def even(self, capacity: int, shards: int) -> list[str]:
        """Cuts of at most ``shards`` shards of the capacity, entries whole, each as near as can be to an equal share of the rest.

        Entries that exceed an equal share of the others are left out of the share.
        """
        sizes = [r[1] for r in self.rows]
        n, cum = len(sizes), [0, *itertools.accumulate(sizes)]
        share, rest, left, huge = 0.0, self.total, shards, set()
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            share = rest / max(1, left)
            if sizes[i] <= share or left <= 1:
                break
            huge.add(i)
            rest, left = rest - sizes[i], left - 1
        plain = [0, *itertools.accumulate(0 if i in huge else s for i, s in enumerate(sizes))]
        many = [0, *itertools.accumulate(i in huge for i in range(n))]
        # shards that the entries from i on need, filled greedily
        need = [0] * (n + 1)
        reach = [0] * n
        j = n
        for i in range(n - 1, -1, -1):
            while cum[j] - cum[i] > capacity:
                j -= 1
            reach[i], need[i] = j, 1 + need[j]
        at, out = 0, []
        for k in range(shards, 1, -1):
            if at >= n:
                break
            target = (plain[n] - plain[at]) / max(1, k - (many[n] - many[at]))
            low = at + 1
            while need[low] > k - 1:  # what follows must fit in the shards that are left
                low += 1
            to = min(max(bisect.bisect_right(cum, cum[at] + target) - 1, low), reach[at])
            if to < reach[at] and abs(cum[to + 1] - cum[at] - target) < abs(cum[to] - cum[at] - target) and to + 1 not in huge:
                to += 1
            at = to
            if at < n:
                out.append(self.rows[at][0])
        return out

    def impossible(self, capacity: int, shards: int) -> bool:
        """True if even divisible entries don't fit, atomic ones taken whole."""
        used, filled = 1, 0
        for _, size, _, atomic in self.rows:
            if atomic:
                if size > capacity:
                    return True
                if filled + size > capacity:
                    used, filled = used + 1, 0
                filled += size
            else:
                more, filled = divmod(filled + size, capacity)
                used += more
                if more and not filled:
                    used, filled = used - 1, capacity
        return used > shards

    def undecided(self, capacity: int, shards: int) -> list[tuple[str, int, int, bool]]:
        """The entries, not atomic, in which some cut of the exact greedy run may fall."""
        cum, at = [0], []
        for r in self.rows:
            cum.append(cum[-1] + r[1])
        lo = hi = 0  # bounds on where the exact run's shard starts, in bytes
        for _ in range(shards):
            # the exact cut is at most lo/hi + capacity; a cut inside entry i may be at its start or anywhere in it
            a, b = bisect.bisect_right(cum, lo + capacity) - 1, bisect.bisect_right(cum, hi + capacity) - 1
            a, b = min(a, len(self.rows)), min(b, len(self.rows))
            at += range(a, min(b + 1, len(self.rows)))
            if a >= len(self.rows):
                break
            lo = cum[a]
            hi = min(hi + capacity, cum[-1])
        return [self.rows[i] for i in sorted(set(at)) if not self.rows[i][3]]


def cuts(groups: DataFrame, shards: int, prefix: int = PREFIX, fetch: int = FETCH) -> list[str]:
    """The hashes at which shards 1, 2, ... begin, of the smallest feasible capacity. groups: (sha, size) by text."""

    def summed(rows: DataFrame, n: int) -> list[tuple[str, int, int, bool]]:
        return [(r.p, r.size, r.n, n >= 64 or r.n == 1) for r in rows.groupBy(F.substring("sha", 1, n).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]

    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return []
    have, depth = Ordered(summed(groups, prefix)), prefix
    lo, hi = max(largest, -(-have.total // shards)), have.total  # the answer lies in lo..hi; hi is feasible
    while True:
        open_at = None
        while lo < hi:
            mid = (lo + hi) // 2
            if have.greedy(mid, shards) is not None:
                hi = mid
            elif have.impossible(mid, shards):
                lo = mid + 1
            else:
                open_at = have.undecided(mid, shards)
                break
        if lo == hi:
            open_at = have.undecided(lo, shards)
        if not open_at:
            if lo == hi:
                return have.even(lo, shards)
            open_at = [r for r in have.rows if not r[3]]
        wanted = groups.sparkSession.createDataFrame([(r[0],) for r in open_at], "p string")
        widths = sorted({len(r[0]) for r in open_at})
        exact = sum(r[2] for r in open_at) <= fetch
        finer: list = []
        for w in widths:
            # at most shards x shards prefixes, each of a few bytes
            rows = groups.join(F.broadcast(wanted.where(F.length("p") == w)), F.substring("sha", 1, w) == F.col("p"), "left_semi")
            finer += summed(rows, 64 if exact else w + 2)
        gone = {r[0] for r in open_at}
        have, depth = Ordered([r for r in have.rows if r[0] not in gone] + finer), depth + 2


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, fetch: int = FETCH) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("sha"), F.floor(F.rand(6) * 65_536).alias("salt"))
    rows = common.written(found, "sizes")
    groups = common.written(rows.groupBy("sha").agg(F.sum("size").alias("size")), "groups")
    at = cuts(groups, shards, prefix, fetch)
    # a cut is the first hash of its shard; entries may be prefixes, which sort before what they begin
    number = F.size(F.filter(F.array(*[F.lit(c) for c in at]), lambda c: c <= F.col("sha"))) if at else F.lit(0)
    buckets = max(1, math.isqrt(rows.count()))
    placed = rows.select("doc_id", "size", "text_crc32", "sha", "salt", number.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "sha", "salt"), F.lit(buckets)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "sha", "salt")
    numbered = placed.withColumn("slot", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
