"""Operator 5: SimHash near-duplicates with pivot distance tables.

Fingerprints: A-Z are lower-cased, words cut at ASCII blanks, 3-word shingles (with
repeats) hashed by XXH64 with seed 42; a bit is set if more than half of the hashes set it.
Fingerprints at most ``radius`` = 2 bits apart are linked; a class is a connected component.

Search.  Only distinct fingerprints are compared, so thousands of copies cost one row.
The 64 bits are cut into four blocks of 16.  Two fingerprints within 2 bits agree in at
least two blocks, so each goes to six buckets, one for each pair of blocks.  In a bucket, the pivot table
(Hamming distances to ``PIVOTS`` reference fingerprints, computed once per row by bit counts)
decides: by the triangle inequality a linked pair differs by at most 2 in every coordinate, so
rows are sorted by their first coordinate, a row is held only against the window within 2 of it,
pairs whose largest coordinate difference exceeds 2 are discarded, and survivors are verified by
their true distance.  A bucket emits a spanning forest of its links (fewer rows than
members), never its pairs.

Buckets with more than ``BUCKET`` distinct fingerprints are first cut by their pivot distances: a row goes to the ranges
of ``RANGE`` distances of its first two pivots, and to the range below where it lies in the first 2, so a linked pair always shares
one.  Two pivots can't cut everything: parts that still hold over ``LARGE`` rows go to the 65 keys of their members' 1-bit neighbourhood; two
fingerprints are within 2 bits exactly if they share such a key, and no key has more than 65 of them.  So no task
holds more than ``LARGE`` fingerprints of a bucket and no link is lost.

Components: alternating large-star and small-star rounds over the links of distinct
fingerprints, each round written to the shared folder.

Defined cases.  Null and empty texts, and texts of blanks only, have fingerprint zero and are linked like any other.  Null ids are
kept, and count as larger than any id; repeated rows and ids share a class.  A very long text is hashed in slices of
``SLICE`` shingles.  An empty table gives an empty result.  Extra columns, whatever their names, are ignored by ``classes``, kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessergraph.llm import common

RADIUS = 2
PIVOTS = 16
BUCKET = 256
#: Rows of a bucket's part that a task holds, and distances that a part spans besides the overlap.
LARGE, RANGE = 16_384, 3
#: Rows that a task of ``one_of_each`` remembers.
SEEN = 500_000
SLICE = 65_536
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of a Hadamard code, far from each other."""
    bits = np.array([[bin(i & j).count("1") & 1 for j in range(64)] for i in range(64)], dtype=np.uint8)
    return np.packbits(bits[[(7 * i + 1) % 64 for i in range(n)]], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + width - 1] if n > 1 else words
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if n > 1 or len(words) == width else [b" ".join(words)]
        hashes = np.fromiter((digest(x, seed) for x in shingles), dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([_signed(fingerprint(t.as_py())) for t in b.column(1)], pa.int64())], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): fp holds the fingerprint's 64 bits as a long, text_key is a hash of the text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return d.mapInArrow(_prints, "doc_id long, text_key long, fp long")


def linked_in_bucket(fps: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, found through their pivot table (rows x pivots)."""
    order = np.lexsort((fps, table[:, 0]))
    fps, table = fps[order], table[order].astype(np.int8)
    bits = fps.astype(np.int64).view(np.uint64)  # bits of a signed number are counted in its absolute value
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    out = []
    for i in range(len(fps) - 1):
        if ends[i] <= i + 1:
            continue
        near = table[i + 1 : ends[i]]
        at = np.flatnonzero(np.abs(near - table[i]).max(1) <= radius)
        at = at[np.bitwise_count(bits[i + 1 + at] ^ bits[i]) <= radius] + i + 1
        for j in at:
            a, b = root(i), root(int(j))
            if a != b:
                parent[b] = a
                out.append((int(fps[i]), int(fps[j])))
    return out


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    fps = pdf.fp.to_numpy()
    if len(fps) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    table = np.frombuffer(b"".join(pdf.table), dtype=np.uint8).reshape(len(fps), PIVOTS)
    found = linked_in_bucket(fps, table)
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _shift(x, n: int):
    return F.shiftrightunsigned(x, n).bitwiseAND(F.lit(0xFFFF))


def _ranges(distance: Column) -> Column:
    """The ranges of RANGE distances that a row belongs to: its own, and the one below if it lies in the first RADIUS of its own."""
    own = F.floor(distance / RANGE).cast("int")
    return F.when(distance % RANGE < RADIUS, F.array(own, own - 1)).otherwise(F.array(own))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links enough to connect every class of the distinct fingerprints ``fp``."""
    fp = F.col("fp")
    distances = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(p))))).cast("byte") for p in pivots()]
    # a distance takes one byte of the packed table
    table = F.unhex(F.concat(*[F.lpad(F.hex(d.cast("long")), 2, "0") for d in distances]))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    uncut = [F.lit(-9).alias("s"), F.lit(-9).alias("t")]
    keys = [F.struct(F.lit(k).alias("k"), (F.shiftleft(_shift(fp, 16 * i), 16) + _shift(fp, 16 * j)).alias("v"), *uncut) for k, (i, j) in enumerate(pairs)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = common.written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    held = rows.join(sizes.where(F.col("n") <= BUCKET), "key", "left_semi")
    crowded = rows.join(sizes.where(F.col("n") > BUCKET), "key", "left_semi")
    cut = crowded.select("fp", "key", F.explode(_ranges(distances[0].cast("int"))).alias("s")).select("fp", "key", "s", F.explode(_ranges(distances[1].cast("int"))).alias("t"))
    cut = common.written(cut.select("fp", F.struct("key.k", "key.v", "s", "t").alias("key")), "cut")
    parts_of = common.written(cut.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "parts")
    held = held.unionByName(cut.join(parts_of.where(F.col("n") <= LARGE), "key", "left_semi")).withColumn("table", table)
    # a bucket's work far exceeds its bytes, so a number is stated: else adaptive execution would put many into one task
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = held.repartition(parts, "key").groupBy("key").applyInPandas(_links, "a long, b long")
    dense = cut.join(parts_of.where(F.col("n") > LARGE), "key", "left_semi").select("fp").distinct()
    ball = dense.select("fp", F.explode(F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("key"))
    least = ball.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return small.unionByName(ball.join(least, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(v, root): for each vertex of the edges (a, b) the least vertex of its component.

    Large-star and small-star rounds; the number of rounds grows with the logarithm of the size.
    """
    spark = edges.sparkSession
    now, path = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    while True:
        # large star: every larger neighbour of a vertex goes to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a vertex and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new, new_path = common.stored(small, "edges")
        common.remove(spark, path)
        now, path = new, new_path
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == was:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        was = sign


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for each row: root tells its class, component_id is the class's least id."""
    found = common.written(fingerprints(docs), "prints")
    distinct = common.written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    placed = common.written(distinct.join(roots, distinct.fp == roots.v, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(placed.join(ids, "root").select("fp", "root", "component_id"), "named")
    return found.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose (id, text_key) the task hasn't had before, as far as it remembers."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        fresh = []
        for pair in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            fresh.append(pair not in seen)
            seen.add(pair)
        if len(seen) > SEEN:
            seen.clear()
        yield b.filter(pa.array(fresh, pa.bool_()))


def one_of_each(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = classes) -> DataFrame:
    """Of each class the document with the least id, all columns; ``classes`` gives each row's doc_id, text_key and root.

    Rows without an id can't be named and all stay. Of an id with several texts in one class one text stays, of rows
    with equal id and text one row. Tasks drop such repeats before texts are shuffled, once, by id and text.
    """
    named = docs.where("doc_id IS NOT NULL")
    keep = classes(named).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.text_key").alias("text_key"))
    own = named.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    kept = own.mapInArrow(_once, own.schema).join(keep, ["id", "text_key"], "left_semi")
    w = Window.partitionBy("id", "text_key").orderBy("id")
    one = kept.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
