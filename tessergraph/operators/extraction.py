"""Documents to triplets: chunk, extract, ground, review and refine with pluggable callables.

An extractor is a callable text -> list of (node_1, edge, node_2) or dicts (``node1``/``node2`` are
taken too).  Calls run in mapInArrow, a chunk at a time, and rows leave in batches of a megabyte or so; a chunk whose call fails becomes a row of
the error column and costs no other chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.text import flushed, scalars
from tessergraph.operators.triplets import Triplets

OUT = "item_id string, chunk_id string, n int, node_1 string, edge string, node_2 string, snippet string, error string"


def as_triplet(x) -> tuple[str, str, str] | None:
    if isinstance(x, dict):
        got = x.get("node_1", x.get("node1")), x.get("edge", x.get("relation")), x.get("node_2", x.get("node2"))
    else:
        got = tuple(x)[:3]
    return tuple(map(str, got)) if len(got) == 3 and all(v is not None and str(v) for v in got) else None


def parse_array(reply: str | None) -> list | None:
    """The JSON array of objects in a reply; None if there is none that parses."""
    m = re.search(r"\[\s*\{.*\}\s*\]", reply or "", re.DOTALL)
    try:
        return json.loads(m[0]) if m else None
    except ValueError:
        return None


def rule_based(text: str) -> list[tuple[str, str, str]]:
    """A deterministic extractor without a model: subject, verb ending in s, object."""
    return [(m[1], m[2], m[3]) for m in re.finditer(r"\b([A-Za-z][\w-]*) ([a-z]+s) ([A-Za-z][\w-]*)", text)]


def extract(chunks: DataFrame, extractor: Callable[[str], list], workers: int | None = None) -> DataFrame:
    """The OUT layout for chunks (item_id, chunk_id, text); ``workers`` asks for that many partitions."""

    def one(item: str, chunk: str, text: str | None) -> Iterator[tuple]:
        try:
            found = [t for t in map(as_triplet, extractor(text or "")) if t]
        except Exception as e:  # reported in the row
            yield item, chunk, 0, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for n, t in enumerate(found):
            yield item, chunk, n, *t, snippet_of(text, t), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*((f.split()[0], {"int": "int32"}.get(f.split()[1], f.split()[1])) for f in OUT.split(", ")), strict=True)
        return flushed((r for batch in batches for row in scalars(batch) for r in one(*row)), names, kinds)

    base = chunks.select(F.col("item_id").cast("string").alias("item_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    return (base.repartition(workers) if workers else base).mapInArrow(run, OUT)


def snippet_of(text: str | None, triplet: tuple[str, str, str]) -> str | None:
    """The first sentence of the text that names both ends."""
    for s in re.split(r"(?<=[.?!])\s+|\n", text or ""):
        if triplet[0] in s and triplet[2] in s:
            return s
    return None


def triplets_of(found: DataFrame) -> Triplets:
    """Triplets with chunk_id and snippet as metadata; failed chunks are left out."""
    meta = F.map_filter(F.create_map(F.lit("chunk_id"), "chunk_id", F.lit("snippet"), "snippet"), lambda _, v: v.isNotNull())
    return Triplets(found.where("error IS NULL").select("node_1", "edge", "node_2", meta.alias("metadata")))


def refine(model: Callable[[str, list], str], rounds: int = 3) -> Callable[[Callable], Callable]:
    """Wraps an extractor: the model sees text and triplets and replies with better ones; a reply that doesn't parse keeps the last set."""

    def wrap(extractor: Callable[[str], list]) -> Callable[[str], list]:
        def run(text: str) -> list:
            now = [t for t in map(as_triplet, extractor(text)) if t]
            for _ in range(rounds):
                got = parse_array(model(text, now))
                if got is not None:
                    now = [t for t in map(as_triplet, got) if t]
            return now

        return run

    return wrap


def review(extractor: Callable[[str, list, str], list], reviewer: Callable[[str, list], str], rounds: int = 3) -> Callable[[str], list]:
    """Extract and review in turn until the review ends with ACCEPT or the rounds do; the last set counts either way."""

    def run(text: str) -> list:
        now, told = [], ""
        for _ in range(rounds):
            now = [t for t in map(as_triplet, extractor(text, now, told)) if t]
            told = reviewer(text, now)
            if told.rstrip().endswith("ACCEPT"):
                break
        return now

    return run


def swarm(extractors: list[Callable[[str], list]], merger: Callable[[list[list]], list] | None) -> Callable[[str], list]:
    """Several extractors read each text, a merger makes one set of theirs; a failing one adds its message; no merger, no triplets."""

    def run(text: str) -> list:
        got = []
        for e in extractors:
            try:
                got.append([t for t in map(as_triplet, e(text)) if t])
            except Exception as x:
                got.append([str(x)])
        return [] if merger is None else merger(got)

    return run


def majority(sets: list[list], least: int = 2) -> list[tuple[str, str, str]]:
    """A merger without a model: what at least that many sets hold, in order of first sight."""
    seen: dict[tuple, int] = {}
    for s in sets:
        for t in dict.fromkeys(x for x in s if isinstance(x, tuple)):
            seen[t] = seen.get(t, 0) + 1
    return [t for t, n in seen.items() if n >= min(least, len(sets))]


def harmonise(found: DataFrame, model: Callable[[list], list]) -> DataFrame:
    """Refine all triplets of an item at once (an item's triplets are one call's input). Provenance returns where a triplet is unchanged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [t for t in map(as_triplet, model(list(zip(pdf.node_1, pdf.edge, pdf.node_2, strict=True)))) if t]
        return pd.DataFrame([(pdf.item_id.iloc[0], n, *t) for n, t in enumerate(got)], columns=["item_id", "n", "node_1", "edge", "node_2"])

    new = found.where("error IS NULL").groupBy("item_id").applyInPandas(run, "item_id string, n int, node_1 string, edge string, node_2 string")
    old = found.where("error IS NULL").groupBy("item_id", "node_1", "edge", "node_2").agg(F.min(F.struct("chunk_id", "snippet")).alias("o"))
    joined = new.join(old, ["item_id", "node_1", "edge", "node_2"], "left")
    return joined.select("item_id", F.col("o.chunk_id").alias("chunk_id"), "n", "node_1", "edge", "node_2", F.col("o.snippet").alias("snippet"), F.lit(None).cast("string").alias("error"))


def ground(triplets: DataFrame, chunks: DataFrame, model: Callable[[str, list], str] | None = None) -> DataFrame:
    """Snippets for triplets (chunk_id, node_1, edge, node_2, snippet) from their chunks; triplets of unknown chunks go."""
    joined = triplets.join(chunks.select("chunk_id", "text"), "chunk_id")

    @F.pandas_udf("string")
    def find(text: pd.Series, a: pd.Series, r: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for t in zip(text, a, r, b, strict=True):
            if model is None:
                out.append(snippet_of(t[0], t[1:]))
            else:
                got = parse_array(model(t[0], [t[1:]])) or []
                out.append(next((g.get("snippet") for g in got if isinstance(g, dict)), None))
        return pd.Series(out, dtype=object)

    return joined.withColumn("snippet", F.coalesce("snippet", find("text", "node_1", "edge", "node_2"))).drop("text")


def distil(items: DataFrame, summarise: Callable[[str], str], bullets: Callable[[str], str], text_col: str = "text") -> DataFrame:
    """The text replaced by its summary and the summary's points, with a blank line between."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else (lambda s: f"{s}\n\n{bullets(s)}")(summarise(t)))

    return items.withColumn(text_col, run(text_col))


# configuration


@dataclass
class ExtractorConfig:
    extraction_type: str = "refine"
    model_name: str = "gpt-4o"
    max_iterations: int = 3
    sleep: float = 0.0
    swarm_size: int = 0
    model_names: list[str] = field(default_factory=list)

    def validate(self) -> ExtractorConfig:
        if self.extraction_type not in REGISTRY:
            raise ValueError(f"unknown extraction type {self.extraction_type!r}; known: {', '.join(sorted(REGISTRY))}")
        if self.max_iterations < 1 or self.sleep < 0:
            raise ValueError("max_iterations must be positive and sleep not negative")
        if self.extraction_type == "swarm" and bool(self.swarm_size) == bool(self.model_names):
            raise ValueError("a swarm is either of one model, with a size, or of several named models")
        return self


@dataclass
class PipelineConfig:
    chunk_method: str = "fixed"
    chunk_size: int = 1000
    chunk_overlap: int = 100
    max_workers: int = 8
    skip_distillation: bool = True
    model_name: str = "gpt-4o-mini"
    scientific_domain: str = "general"
    extractor: dict = field(default_factory=lambda: {"extraction_type": "refine"})

    def validate(self) -> PipelineConfig:
        if self.chunk_method != "fixed":
            raise ValueError("only fixed chunking is configurable")
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and the overlap smaller")
        if self.max_workers <= 0 or not self.model_name or not self.scientific_domain:
            raise ValueError("workers, model and domain must be given")
        return self

    @classmethod
    def of(cls, values: dict) -> PipelineConfig:
        """Unknown keys are ignored."""
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values}).validate()

    def merged(self, overrides: dict | None) -> PipelineConfig:
        return self.of(asdict(self) | (overrides or {}))


REGISTRY: dict[str, Callable] = {"refine": refine, "review": review, "swarm": swarm}


def register(name: str, factory: Callable) -> None:
    REGISTRY[name] = factory


def extractor_config(values: dict) -> ExtractorConfig:
    if "extraction_type" not in values:
        raise ValueError("extraction_type is required")
    return ExtractorConfig(**{f.name: values[f.name] for f in fields(ExtractorConfig) if f.name in values}).validate()


def generate(items: DataFrame, extractor: Callable[[str], list], config: PipelineConfig | None = None, refiner: Callable[[list], list] | None = None) -> DataFrame:
    """Chunk, extract and, with a refiner, harmonise (item_id, text): the OUT layout, provenance kept throughout."""
    from tessergraph.functions.text import chunk_fixed

    c = (config or PipelineConfig()).validate()
    found = extract(chunk_fixed(items, "item_id", "text", c.chunk_size, c.chunk_overlap), extractor, c.max_workers)
    return harmonise(found, refiner) if refiner else found
