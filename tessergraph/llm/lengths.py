"""Operator 9: exact length histogram of encoded documents.

Each task encodes its texts and counts them by length; Spark sums the counts.  The
histogram is as long as there are distinct lengths, however many documents there are.
Suffix sums over it answer, for every context limit, how many documents exceed it,
how many tokens truncation keeps and loses, and any quantile, all exactly.

The histogram is written to the shared folder before it is summed, since blocks and lengths both
read it and texts must be encoded once.  The suffix sums run in two levels (blocks of ``BLOCK`` lengths, then lengths within a
block), so no task sorts the whole histogram.

The tokenizer is a byte-level BPE given as a tiktoken rank file; the driver reads it
from ``ranks_path`` and ships its bytes, so executors need no file.

Defined cases.  Null and empty texts have length 0 and count as documents.  Texts of any length, runs of blanks and words of any length
are encoded as the pattern says; a chunk takes some 70 bytes of memory for each of its own.  Special-token
strings in a text are ordinary text.  Ids are not read; repeated rows each count.  An empty
table gives an empty histogram.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessergraph.llm import common

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in that pattern.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of a chunk that the library isn't given.
LONG = 2000
BLOCK = 64
_encoders: dict = {}


class Encoder:
    """The tokenizer of a rank file's bytes. Texts with a chunk of LONG characters or more are cut and merged here: the
    library's pattern overflows its stack on long runs of blanks, and its merging takes quadratic time on long chunks."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.longest = max(map(len, self.ranks))
        self.library = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})
        self.chunks = regex.compile(SPLIT.replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s+", f"[{BLANKS}]+"))
        self.long_run = regex.compile(f"[{BLANKS}\x1c-\x1f]{{{LONG}}}|[^{BLANKS}]{{{LONG}}}")

    def tokens(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.library.encode_ordinary(text)
        words = text.split()
        n = sum(map(len, words))
        if max(map(len, words), default=0) < LONG and len(text) - n - len(words) < LONG - 2 or not self.long_run.search(text):
            return self.library.encode_ordinary(text)
        return self.by_chunks(text)

    def by_chunks(self, text: str) -> list[int]:
        out, one = [], self.library._encode_single_piece
        for m in self.chunks.finditer(text):
            chunk = m[0]
            out += one(chunk) if len(chunk) < LONG else self.merged(chunk.encode())
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Byte-pair merging of one chunk, the best-ranked pair first, then the leftmost; n log n steps by a heap."""
        ranks, n, longest = self.ranks, len(piece), self.longest
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def rank(i: int) -> int:
            """The rank of the part at i joined with the next one, or -1."""
            j = after[i]
            if j >= n or after[j] - i > longest:
                return -1
            return ranks.get(piece[i : after[j]], -1)

        now = array("q", map(rank, range(n)))
        heap = [r << 40 | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & (1 << 40) - 1
            if now[i] != x >> 40:
                continue  # the pair has changed since
            j = after[i]
            after[i], now[j] = after[j], -1
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = rank(k)
                    if now[k] >= 0:
                        heappush(heap, now[k] << 40 | k)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


def encoder(ranks: bytes) -> Encoder:
    """One per worker process."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def count_lengths(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(ranks).tokens, Counter()
        for b in batches:
            seen.update(len(encode(t)) if t else 0 for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    return run


def histogram(docs: DataFrame, text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """(n_tokens, n_docs)."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count_lengths(ranks), "n_tokens long, n_docs long")
    return found.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as context limit: documents and tokens from L up, the share of documents
    of at most L, and the totals that truncation to L keeps and loses."""
    h = common.written(hist, "lengths").withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_above") for c in ("bd", "bt")], F.sum("bd").over(whole).alias("docs"), F.sum("bt").over(whole).alias("total"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    s = h.join(tops, "block").select("n_tokens", "n_docs", "docs", "total", (F.sum("n_docs").over(inner) + F.col("bd_above")).alias("docs_from"), (F.sum("tokens").over(inner) + F.col("bt_above")).alias("tokens_from"))
    kept = F.col("total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return s.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (F.col("docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"), "docs",
        kept.alias("truncated_total"), (F.col("total") - kept).alias("lost_tokens"), F.col("total").alias("total_tokens"),
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length L with at least a share q of the documents at or below it; None without documents."""
    return sums.where(F.col("docs_upto") >= F.ceil(F.lit(q) * F.col("docs"))).agg(F.min("n_tokens")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to ``limit``, which need not be a length that occurs."""
    r = sums.where(F.col("n_tokens") >= limit).agg(F.min(F.struct("n_tokens", "docs_from", "tokens_from", "total_tokens")).alias("r")).first().r
    if r is None:
        return sums.agg(F.max("total_tokens")).first()[0] or 0
    return r.total_tokens - r.tokens_from + limit * r.docs_from


def op9_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
