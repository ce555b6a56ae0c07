"""Near-duplicates of the pipeline: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Words are those of op5 (A-Z lower-cased, cut at ASCII blanks); a text of fewer than five words is one shingle.
Shingles are compared by their XXH64.  Similar texts are linked; a class is a connected component.

Search.  No radius of a SimHash holds every pair of similarity 0.8, so candidates come from prefixes instead, which
lose none.  All shingles have one order, rarest first as far as a sample tells (any order is right, the sample only
saves work), and a set of n sends its first 3n/10 + 1 as keys.  If two sets have similarity 0.8, the one whose keys end first
in that order lacks at most n - 4(n+m)/9 of them in the other, so both hold over n/10 keys of both.  A set with fewer keys
that any other set has is dropped with its keys, in two rounds: that leaves few but near copies.  In what is left keys are
ordered anew, rarest first by their counts; the first s - n/10 of a set's s shared keys hold one of each similar set's.
Every candidate is verified by its whole sets, in whole numbers.

Large groups.  Equal sets are one.  The members of a bucket (a shared key) are first held against
the one that has the key earliest, the text the others were most likely made from, at most STARS such pairs for a set; then buckets whose members are all in one
component are left, and in the others members of different components are held against each other.  Near copies so
cost a row or two each, not a pair each.  Keys that the sample shows in many texts are salted.

Pivot distance tables.  A set's fingerprint has a bit for each shingle's hash modulo its size, set if an odd number of shingles
hit it, so two fingerprints differ in at most as many bits as the sets in shingles: (n+m)/9 for similar ones.  In a
bucket, distances to ``PIVOTS`` reference fingerprints are computed once; pairs whose largest coordinate difference
exceeds that bound are discarded, survivors are held to it by their own distance, and only what is left becomes a
candidate row.  Buckets of over ``BLOCK`` members are cut into blocks, compared two by two in tasks of their own.

Defined cases.  Null and empty texts, and texts of blanks only, have the empty set and are one class.  Null ids count as
larger than any id.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm import common, simhash

WIDTH = 5
#: Texts looked at for the order of shingles, and shingles it may name.
SAMPLE, COMMON = 10_000, 50_000
#: Sampled texts that make a key hot, and the parts such a key is dealt to.
HOT, SALTS = 100, 64
#: Pairs by which a set is first held against others.
STARS = 2
#: Texts whose sets are held at once, and sets that a task remembers.
ROWS, SEEN = 200, 1_000_000
#: Reference fingerprints of a bucket, and members that are compared in one task.
PIVOTS, BLOCK = 8, 1024
#: Bits of the filter that tells which texts' sets are wanted again.
FILTER = 1 << 25


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(simhash.ASCII_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.int64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64)).view(np.int64)


def fingerprint(h: np.ndarray) -> bytes:
    """Parity bits of the hashes; the number of bits is the least power of two over 1.5 times theirs, 64 at least."""
    size = 64
    while size < 1.5 * len(h):
        size *= 2
    return np.packbits((np.bincount(h & (size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray) -> np.ndarray:
    """Fingerprints of half the size: a hash modulo the half hits the same bit as both of the whole's."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


def similar_in(sig: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, bits: list[bytes], across: bool) -> list[tuple[int, int]]:
    """Pairs of a bucket's members that can be similar: of different roots and, if ``across``, different sides."""
    out, sizes = [], np.array(list(map(len, bits)))
    for size in np.unique(sizes):
        own, wider = np.flatnonzero(sizes == size), np.flatnonzero(sizes == 2 * size)
        words = np.frombuffer(b"".join(bits[i] for i in own), dtype=np.uint64).reshape(len(own), -1)
        if len(wider):
            wide = np.frombuffer(b"".join(bits[i] for i in wider), dtype=np.uint64).reshape(len(wider), -1)
            words = np.concatenate([words, _folded(wide)])
        rows = np.concatenate([own, wider])
        if len(rows) < 2:
            continue
        pivots = words[:: -(-len(rows) // PIVOTS)]
        table = np.stack([np.bitwise_count(words ^ p).sum(1, dtype=np.int32) for p in pivots], axis=1)
        order = np.argsort(table[:, 0], kind="stable")
        rows, words, table = rows[order], words[order], table[order]
        narrow = sizes[rows] == size
        m, c, s = n[rows].astype(np.int64), root[rows], side[rows]
        # a similar set has at most 5/4 of the size, so at most n/4 shingles differ
        ends = np.searchsorted(table[:, 0], table[:, 0] + m // 4, side="right")
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, max(i + 1, ends[i]))
            j = j[(c[j] != c[i]) & (narrow[j] | narrow[i]) & (5 * np.minimum(m[j], m[i]) >= 4 * np.maximum(m[j], m[i]))]
            if across:
                j = j[s[j] != s[i]]
            j = j[9 * np.abs(table[j] - table[i]).max(1, initial=0) <= m[j] + m[i]]
            j = j[9 * np.bitwise_count(words[j] ^ words[i]).sum(1, dtype=np.int64) <= m[j] + m[i]]
            x = int(sig[rows[i]])
            out += [(min(x, y), max(x, y)) for y in sig[rows[j]].tolist()]
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows sorted by (key, i, j), the columns of a bucket's part."""

    def pairs_of(t: pa.Table) -> list[tuple[int, int]]:
        if len(t) < 2:
            return []
        sig, n, root, side = (t.column(x).to_numpy() for x in ("sig", "n", "root", "side"))
        return similar_in(sig, n, root, side, t.column("bits").to_pylist(), t.column("i")[0].as_py() != t.column("j")[0].as_py())

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not len(t):
            continue
        ids = [t.column(x).to_numpy() for x in ("key", "i", "j")]
        starts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        found, at = [], 0
        for end in starts.tolist():
            found += pairs_of(t.slice(at, end - at))
            at = end
        rest = t.slice(at)
        yield batch_of(sorted(set(found)))
    if rest is not None:
        yield batch_of(sorted(set(pairs_of(rest))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several of the sampled texts, sorted, and in how many."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()))], ["h"])

    step = -(-max(1, docs.count()) // SAMPLE)
    some = _texts(docs).where(F.pmod("text_key", F.lit(step)) == 0).dropDuplicates(["text_key"]).select("text")
    counts = some.mapInArrow(listed, "h long").groupBy("h").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    rows.sort(key=lambda r: r.h)
    return np.array([r.h for r in rows], dtype=np.int64), np.array([r["count"] for r in rows], dtype=np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, sig, n, hot, keys, bits): of each text's set a hash, the size, the first shingles in the common
    order, the last ``hot`` of them hot, and the fingerprint.  A set that the task has seen sends no keys again."""
    names, counts = _frequent(docs)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for b in batches:
            sigs, sizes, hot, keys, bits = [], [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py())
                sigs.append(simhash._signed(xxhash.xxh3_64_intdigest(h.tobytes())))
                sizes.append(len(h))
                often = 0
                if len(seen) >= SEEN:
                    seen.clear()
                if sigs[-1] in seen or not len(h):
                    h = h[:0]
                    bits.append(None)
                else:
                    seen.add(sigs[-1])
                    bits.append(fingerprint(h))
                    first = 3 * len(h) // 10 + 1
                    if len(names):
                        at = np.minimum(np.searchsorted(names, h.view(np.int64)), len(names) - 1)
                        found = np.where(names[at] == h, counts[at], 0)
                        order = np.argsort(found, kind="stable")[:first]
                        h, often = h[order], int((found[order] >= HOT).sum())
                    h = h[:first].copy()
                keys.append(h)
                hot.append(often)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hot, pa.int32()), _lists(keys), pa.array(bits, pa.binary())], ["doc_id", "text_key", "sig", "n", "hot", "keys", "bits"])

    return _texts(docs).mapInArrow(ordered, "doc_id long, text_key long, sig long, n int, hot int, keys array<long>, bits binary")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, dtype=np.int64)])))


def _whole(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, hashes) of the sets ``wanted``, cut again from their texts, so that sets needn't be stored or moved for the others.

    Texts are told by one bit of FILTER each; a bit that two texts share only lets through a set that the join drops.
    """
    keys = found.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("text_key").alias("k"))
    bit = F.col("k").bitwiseAND(F.lit(FILTER - 1))
    words = keys.select(F.shiftright(bit, 3).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)).cast("int")).alias("bits")).groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER // 8, dtype=np.uint8)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            k = b.column(1).to_numpy() & (FILTER - 1)
            rows = np.flatnonzero(bits[k >> 3] >> (k & 7) & 1)
            for some in (rows[i : i + ROWS] for i in range(0, len(rows), ROWS)):
                found = [shingles(b.column(0)[int(i)].as_py()) for i in some]
                sigs = [simhash._signed(xxhash.xxh3_64_intdigest(h.tobytes())) for h in found]
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), _lists(found)], ["sig", "hashes"])

    made = _texts(docs).select("text", "text_key").mapInArrow(cut, "sig long, hashes array<long>")
    return made.join(wanted, "sig", "left_semi").dropDuplicates(["sig"])


def _sizes(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have similarity 0.8."""
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def _verified(pairs: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have Jaccard similarity 0.8 or more."""
    pairs, pairs_at = common.stored(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    hashes, hashes_at = common.stored(_whole(docs, found, wanted), "hashes")
    left = pairs.join(hashes.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(hashes.select(F.col("sig").alias("b"), F.col("hashes").alias("y")), "b")
    out = common.written(both.where(F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b"), "links")
    common.remove(pairs.sparkSession, pairs_at)
    common.remove(pairs.sparkSession, hashes_at)
    return out


#: A hot key's members are dealt to parts; every part counts as shared.
PART = ("key", "salt")


def _shared(rows: DataFrame) -> DataFrame:
    """(key, sig, n, at, hot, salt, df) of the keys that several sets have, of sets with enough of them to be similar to any."""
    w = Window.partitionBy(*PART)
    both = rows.withColumn("lo", F.min("sig").over(w)).withColumn("hi", F.max("sig").over(w)).withColumn("df", F.when(F.col("hot"), F.lit(1 << 40)).otherwise(F.count("*").over(w)))
    both, at = common.stored(both.where("hot OR lo <> hi").drop("lo", "hi").dropDuplicates([*PART, "sig"]), "shared")
    enough = both.groupBy("sig").agg(F.count("*").alias("c"), F.min("n").alias("n")).where("c > n div 10").select("sig")
    out = common.written(both.join(enough, "sig", "left_semi"), "shared")
    common.remove(rows.sparkSession, at)
    return out


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): links enough to connect every class of the sets ``found`` of the texts, by their ``sig``."""
    keys = found.select("sig", "n", (F.size("keys") - F.col("hot")).alias("rare"), F.posexplode("keys").alias("at", "key")).withColumn("hot", F.col("at") >= F.col("rare")).drop("rare")
    keys = keys.withColumn("salt", F.when(F.col("hot"), F.pmod("sig", F.lit(SALTS))).otherwise(0).cast("int"))
    shared = _shared(_shared(keys).drop("df"))
    # a pair for each other member and the one with the least of its own before the key
    heads = shared.groupBy("key").agg(F.min(F.struct("at", "n", "sig")).alias("head"))
    near = shared.join(heads, "key").where("sig <> head.sig").where(_sizes(F.col("n"), F.col("head.n")))
    best = Window.partitionBy("b").orderBy(F.desc("c"), "a")
    stars = near.groupBy(F.col("head.sig").alias("a"), F.col("sig").alias("b")).agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= STARS)
    stars = common.written(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    first = _verified(stars, docs, found)
    roots = simhash.components(first).select(F.col("v").alias("sig"), "root")
    # of a set's s shared keys the first s - n div 10, rarest first, hold one of each similar set's
    own = Window.partitionBy("sig")
    rare = shared.withColumn("r", F.row_number().over(own.orderBy("df", "key"))).withColumn("s", F.count("*").over(own)).where("r <= s - n div 10").select("key", "sig", "n")
    placed = common.written(rare.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("key", "blocks")
    mixed = placed.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("sig"), "blocks").cast("int"))
    mixed = mixed.join(found.where("bits IS NOT NULL").groupBy("sig").agg(F.first("bits").alias("bits")), "sig")
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mixed.select("key", "i", "j", "sig", "n", "root", "side", "bits").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(_compared, "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    return first.unionByName(_verified(pairs, docs, found))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, sig, root, component_id) for each row: root tells its class, component_id is the class's least id."""
    found, at = common.stored(sets(docs), "sets")
    edges = links(docs, found)
    found_now = common.written(found.select("doc_id", "text_key", "sig"), "texts")
    common.remove(docs.sparkSession, at)
    roots = simhash.components(edges)
    distinct = found_now.groupBy("sig").agg(F.min("doc_id").alias("least"))
    placed = common.written(distinct.join(roots, distinct.sig == roots.v, "left").select("sig", F.coalesce("root", "sig").alias("root"), "least"), "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(placed.join(ids, "root").select("sig", "root", "component_id"), "named")
    return found_now.join(named, "sig").select("doc_id", "text_key", "sig", "root", "component_id")
