"""Operator 7: counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their beginnings of 4 to 7 letters.  A feature's value
is the root of its share of the words (per cent, at most 4, over words + 20), so long texts aren't
toxic for holding much.  Features are those that toxic training texts hold clearly more often.

Counterfactuals.  In labelled texts that mention a group, every identity term is swapped for
the next one of its list; the squared change of the text's logit, times ``penalty``, is added to the
loss.  So the model can't lean on who is mentioned, and neutral mentions aren't taken for toxicity.

Training takes labels only of rows whose crc32(doc_id) mod 3 isn't 1.  Labels, language, source
and id are never inputs of a score.  The model is fitted on a sample, by id hash, of about ``SAMPLE``
labelled rows (all, where there are fewer); features are counted on the executors, and only the at most ``FEATURES`` chosen ones and
the sample's values for them reach the driver.  Scoring reads every whole text, in one
pass without a shuffle.  The logit is shifted so that 0.7 is the cut with the best F1 in training.

Defined cases.  Null and empty texts have no words and get the model's base score.  A document labelled more than once is
toxic if any label says so, and an id in several rows trains with the least of its texts; labels with a null id or mark are left out, and so are rows with a null id in training; they are scored,
and never held out.  Repeated rows are scored alike.  Without toxic training rows every score is 0.
An empty table gives an empty result.  Extra columns are ignored by ``scores`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.llm import common

SAMPLE = 20_000
FEATURES = 4000
CUT = 0.7
PREFIXES = (4, 5, 6, 7)
WORDS = re.compile(r"[^\W\d_]+")
#: Terms of one list stand in for each other.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("immigrants", "refugees", "locals"), ("mexican", "american", "chinese", "african", "european", "arab"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def swaps(identities=IDENTITIES) -> dict[str, str]:
    return {x: terms[(i + 1) % len(terms)] for terms in identities for i, x in enumerate(terms)}


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


def tokens(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


def value(count: float, words: int) -> float:
    return math.sqrt(min(4.0, 100.0 * count / (words + 20)))


def swapped(words: Counter, table: dict[str, str]) -> Counter | None:
    """The words with identity terms swapped; None if there are none."""
    if not any(w in table for w in words):
        return None
    out: Counter = Counter()
    for w, n in words.items():
        out[table.get(w, w)] += n
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    shift: float = 0.0
    scale: float = 1.0
    trained: bool = False

    def __post_init__(self):
        self.seen: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.seen = {}

    def logit(self, words: Counter) -> float:
        n, found, seen, weights = words.total(), Counter(), self.seen, self.weights
        for w, c in words.items():
            own = seen.get(w)
            if own is None:
                if len(seen) > 200_000:
                    seen.clear()
                own = seen[w] = tuple(f for f in word_features(w) if f in weights)
            for f in own:
                found[f] += c
        return self.bias + sum(weights[f] * value(c, n) for f, c in found.items())

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        z = self.scale * (self.logit(tokens(text)) - self.shift) + math.log(CUT / (1 - CUT))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list[int]] = {}

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["feature", "pos", "neg"])

    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            for f in {f for w in tokens(text.as_py()) for f in word_features(w)}:
                seen.setdefault(f, [0, 0])[not toxic] += 1
            if len(seen) > 400_000:
                yield table()
                seen.clear()
    if seen:
        yield table()


def _vectors(shared, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(shared.value)}

        def vector(words: Counter) -> tuple[list[int], list[float]]:
            found: Counter = Counter()
            for w, c in words.items():
                for f in word_features(w):
                    if f in at:
                        found[at[f]] += c
            n = words.total()
            return list(found), [value(c, n) for c in found.values()]

        for b in batches:
            out = []
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = tokens(text.as_py())
                other = swapped(words, table)
                out.append((int(toxic), *vector(words), *(vector(other) if other else ([], [])), other is not None))
            types = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["y", "i", "v", "ci", "cv", "mentions"])

    return run


def fit_weights(y: np.ndarray, x: list, other: list, features: int, penalty: float, ridge: float = 3e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Adam on the logistic loss plus penalty * mean squared logit change. x: (indices, values) of each row; other: of its swap, or None."""

    def flat(rows):
        r = np.concatenate([np.full(len(i), k, dtype=np.int64) for k, (i, _) in enumerate(rows)] or [np.zeros(0, np.int64)])
        return r, np.concatenate([np.asarray(i, dtype=np.int64) for i, _ in rows] or [np.zeros(0, np.int64)]), np.concatenate([np.asarray(v, dtype=np.float64) for _, v in rows] or [np.zeros(0)])

    n, w, b = len(y), np.zeros(features), -2.0
    r, c, v = flat(x)
    # a pair's change of logit is linear in the weights: its features are the difference
    pairs = [([*a[0], *o[0]], [*a[1], *(-np.asarray(o[1]))]) for a, o in zip(x, other, strict=True) if o is not None]
    pr, pc, pv = flat(pairs)
    m, s = np.zeros(features), np.zeros(features)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=v * w[c], minlength=n) + b, -60, 60)))
        g = np.bincount(c, weights=v * (p - y)[r], minlength=features) / n + ridge * w
        if pairs:
            change = np.bincount(pr, weights=pv * w[pc], minlength=len(pairs))
            g += penalty * 2 * np.bincount(pc, weights=pv * change[pr], minlength=features) / len(pairs)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        b -= 0.5 * float((p - y).mean())
    return w, b


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F1, halfway between its neighbours."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k]) - 0.5


def train(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, sample: int = SAMPLE, features: int = FEATURES, identities=IDENTITIES) -> Model:
    """Fit on the labelled documents that aren't held out."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # a hash takes `sample` rows or so; twice that can't be exceeded but by chance of nil
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks.limit(2 * sample)), "doc_id")
    # an id in several rows is one row of the sample, with the least of its texts
    rows = common.written(own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", (F.col("toxic") > 0).alias("toxic")), "labelled")
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = totals.get(True, 0), totals.get(False, 0)
    if not pos:
        return Model()
    counted = rows.mapInArrow(_counted, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lean = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    chosen = [r.feature for r in counted.where("pos >= 3").where(lean > 1).orderBy(F.desc(F.col("pos") * lean), "feature").limit(features).select("feature").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    got = rows.mapInArrow(_vectors(shared, swaps(identities)), "y int, i array<int>, v array<double>, ci array<int>, cv array<double>, mentions boolean").collect()
    got = sorted(got, key=lambda r: (r.y, r.i, r.v))
    y = np.array([r.y for r in got], dtype=np.float64)
    w, b = fit_weights(y, [(r.i, r.v) for r in got], [(r.ci, r.cv) if r.mentions else None for r in got], len(chosen), penalty)
    z = np.array([b + sum(w[i] * v for i, v in zip(r.i, r.v, strict=True)) for r in got])
    return Model(dict(zip(chosen, map(float, w), strict=True)), float(b), best_cut(z, y), 1.0, True)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())], [b.schema.names[0], "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(shared), "doc_id long, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that aren't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < CUT for t in b.column(at).cast(pa.string())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
