"""Bibliographic records: aliases, parsing of free-form metadata, linkage by any shared identifier."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.ids import ID_FIELDS, item_id

ALIASES = {"pmid": "pm_id", "pmcid": "pmc_id", "gsid": "gs_id", "extraid": "extra_id", "gsmeta": "gs_meta", "gs_metadata": "gs_meta", "scrapeddate": "scraped_date", "scrapedate": "scraped_date"}


def canonical_names(df: DataFrame) -> DataFrame:
    """Columns in lower case, aliases renamed; the first of several columns for one name that isn't null wins."""
    found: dict[str, list[Column]] = {}
    for c in df.columns:
        low = c.strip().lower()
        found.setdefault(ALIASES.get(low, low), []).append(F.col(f"`{c}`"))
    return df.select(*[F.coalesce(*cs).alias(name) if len(cs) > 1 else cs[0].alias(name) for name, cs in found.items()])


def with_id(df: DataFrame) -> DataFrame:
    """df with its item id, or the id given; rows without any identifier raise an error when read."""
    made = item_id(**{c: F.col(c) for c in ID_FIELDS if c in df.columns})
    given = F.col("id") if "id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("id", F.coalesce(given, made, F.raise_error(F.lit("a record needs an identifier")).cast("string")))


def parse_metadata(text: Column) -> Column:
    """JSON, else a Python literal, else an empty map."""

    @F.pandas_udf("map<string,string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(metadata_of)

    return run(text)


def metadata_of(text: str | None) -> dict[str, str]:
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        if isinstance(found, dict):
            return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in found.items() if v is not None}
    return {}


def linked(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = (*ID_FIELDS, "id"), key: str = "rec") -> DataFrame:
    """(left, right, matches, conflicts): record pairs that share an identifier, found by one equi-join per field.

    Where some shared fields agree and others differ, conflicts > 0.
    """
    own = [f for f in fields if f in a.columns and f in b.columns]
    left = a.select(F.col(key).alias("left"), *[F.col(f).alias(f"l_{f}") for f in own])
    right = b.select(F.col(key).alias("right"), *[F.col(f).alias(f"r_{f}") for f in own])
    pairs = None
    for f in own:
        one = left.select("left", F.col(f"l_{f}").alias("v")).join(right.select("right", F.col(f"r_{f}").alias("v")), "v").select("left", "right")
        pairs = one if pairs is None else pairs.unionByName(one)
    both = pairs.distinct().join(left, "left").join(right, "right")
    count = lambda test: sum((F.coalesce(test(F.col(f"l_{f}"), F.col(f"r_{f}")).cast("int"), F.lit(0)) for f in own), F.lit(0))
    return both.select("left", "right", count(lambda x, y: x == y).alias("matches"), count(lambda x, y: x != y).alias("conflicts"))


def citations(items: DataFrame) -> DataFrame:
    """(from_id, to_id, kind): nested citation lists as an edge table."""
    out = None
    for kind in ("citations", "cited_by"):
        if kind in items.columns:
            one = items.select(F.col("id").alias("from_id"), F.explode(kind).alias("c")).select("from_id", F.col("c.id").alias("to_id"), F.lit(kind).alias("kind"))
            out = one if out is None else out.unionByName(one)
    return out
