"""Operator 3: quality rules with risk-controlled thresholds.

Features of every whole text (counts only, so texts can be long):
words, code points in words, symbols, repeated lines, words in repeated 3-word windows.
A text fails the base rule with under 50 words or when over half of its words lie in
repeated windows.

Thresholds.  Each rule turns the counts into a score in 1/1000ths.  The labelled rows
that pass the base rule are counted, good ones and others, per stratum (language) and bins of all rules.
For a cutoff t, the good rows scoring above t would be rejected; the exact
(Clopper-Pearson) upper bound on that rate, at confidence 1 - delta / tests, must be at most
``alpha / rules``.  Multiple testing: a rule's cutoffs in ``GRID`` are tested in a fixed sequence from
the loosest and end with the first that fails, which needs no further correction; strata x
rules such sequences share delta (Bonferroni).  Of the cutoffs that pass, all certified at once, the one is
used that rejects the most other rows over good ones, beyond what earlier rules reject; if none gains, the rule isn't applied.  So
a stratum falsely rejects at most alpha of its good texts, with probability 1 - delta
over all strata and rules at once.  Where too few labels exist to certify any cutoff, the rule
is not applied there.  A text is kept if it passes the base rule and no rule rejects it.

Bounds.  All labelled rows count.  Counting is by groupBy, so a stratum with a third of all rows
is summed in the tasks first; what a stratum's selection reads is at most one row for each combination of bins.
The thresholds are broadcast only if they have at most MAX_STRATA strata, and else joined.

Defined cases.  A null text has no words and fails the base rule.  A null language is a
stratum of its own.  A document labelled more than once is good only if all its labels
are; an id in several rows is one trial, of its least language and scores.  Good texts that the base rule fails aren't in the guarantee.  Labels with a null id or quality are left out; a document with a null id is scored,
unlabelled.  Repeated rows are rows of their own.  Empty tables give empty results; without labels only the base rule applies.
Other columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.llm import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rule: what it divides, in 1/1000ths.
RULES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: Scores at and above this share the last bin.
LAST_BIN = 20_000
#: Cutoffs that are tested, in 1/1000ths.
GRID = (50, 100, 150, 200, 250, 300, 350, 400, 450, 500, 750, 1000, 2000, 4000, 6000, 8000, 10_000, 12_000, 15_000, 19_000)
MAX_STRATA = 10_000
WHITE = b" \t\n\x0b\x0c\r"


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # splits at exactly the six ASCII blanks
    n = len(words)
    # code points: bytes that don't continue a character
    word_chars = len(text or "") - sum(data.count(c) for c in WHITE)
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    repeated = 0
    if n >= 4:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            often = {g for g, c in Counter(grams).items() if c > 1}
            last = 0
            for i, g in enumerate(grams):
                if g in often:
                    repeated += i + 3 - max(i, last)
                    last = i + 3
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [counts(t.as_py()) for t in b.column("text")]
        keep = [i for i, f in enumerate(b.schema.names) if f != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS)))], [*(b.schema.names[i] for i in keep), *COUNTS])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang) and COUNTS of each row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_counted, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def score(rule: str):
    top, bottom = RULES[rule]
    return F.least(F.coalesce(F.expr(f"{top} * 1000 div nullif({bottom}, 0)"), F.lit(0)), F.lit(LAST_BIN)).cast("long")


def _at_most(bad: int, n: int, p: float) -> float:
    """P(X <= bad) of n trials at rate p: the regularised incomplete beta function by its continued fraction."""
    a, b, x = n - bad, bad + 1, 1 - p
    if x * (a + b + 2) > a + 1:  # the fraction converges fast on the other side
        a, b, x = b, a, p
        swap = True
    else:
        swap = False
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    part = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * f / a
    return 1 - part if swap else part


def upper_bound(bad: int, n: int, miss: float) -> float:
    """Exact one-sided upper confidence bound on a rate: the p at which P(X <= bad) = miss."""
    if bad >= n:
        return 1.0
    lo, hi = max(1e-12, bad / n), 1 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _at_most(bad, n, mid) > miss else (lo, mid)
    return hi


def _select(alpha: float, delta: float, strata: int):
    miss, limit = delta / (strata * len(RULES)), alpha / len(RULES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.good.sum())
        out = {"lang": pdf.lang.iloc[0], "good": n}
        left = pdf  # rows that no earlier rule rejects
        for rule in RULES:
            best = 0, None
            for t in reversed(GRID):
                bad = int(pdf.good[pdf[rule] > t].sum())
                if bad > limit * n or upper_bound(bad, n, miss) > limit:
                    break
                hit = left[left[rule] > t]
                gain = int(hit.poor.sum()) - int(hit.good.sum())
                if gain > best[0]:
                    best = gain, t
            out[rule] = best[1]
            if best[1] is not None:
                left = left[left[rule] <= best[1]]
        return pd.DataFrame([out]).astype({r: "Int64" for r in RULES})

    return run


def thresholds(found: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """(lang, good, a cutoff or null for each rule) from all labelled rows."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))

    def bin_of(rule: str):
        """The least value of the score's bin: scores between two cutoffs act alike."""
        edge = F.lit(0)
        for t in GRID:
            edge = F.when(score(rule) > t, t + 1).otherwise(edge)
        return edge.cast("long").alias(rule)

    # a label is one trial, however many rows have its id
    first = F.min(F.struct("lang", *[bin_of(r) for r in RULES], (F.col("quality") == 1).cast("long").alias("g"))).alias("first")
    scored = found.where(~base_failed()).join(marks, "doc_id").groupBy("doc_id").agg(first).select("first.*")
    table = scored.groupBy("lang", *RULES).agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("poor"))
    strata = max(1, table.select("lang").distinct().count())
    return table.groupBy("lang").applyInPandas(_select(alpha, delta, strata), "lang string, good long, " + ", ".join(f"{r} long" for r in RULES))


def _rejected(cuts):
    return F.greatest(F.lit(False), *[F.coalesce(score(r) > cuts[r], F.lit(False)) for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    found = common.written(features(docs), "quality")
    cuts = common.written(thresholds(found, labels, alpha, delta), "cutoffs").withColumnRenamed("lang", "_lang")
    if cuts.count() <= MAX_STRATA:
        cuts = F.broadcast(cuts)
    out = found.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rejected = _rejected(F.struct(*RULES))
    return out.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """The documents, all columns, that the rules keep.

    A first pass counts for the thresholds and keeps only counts; a second emits text and counts together, so
    texts aren't shuffled.
    """
    cuts = common.written(thresholds(common.written(features(docs), "quality"), labels, alpha, delta), "cutoffs")
    few = cuts.count() <= MAX_STRATA
    cuts = cuts.select(F.struct("*").alias("_cuts"))
    named = docs.select(F.struct("*").alias("_row"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("lang"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS)))], ["_row", "lang", *COUNTS])

    schema = named.select("_row", "lang", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    counted = named.mapInArrow(run, schema).where(~base_failed())
    out = counted.join(F.broadcast(cuts) if few else cuts, F.col("lang").eqNullSafe(F.col("_cuts.lang")), "left")
    return out.where(~_rejected(F.col("_cuts"))).select("_row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
