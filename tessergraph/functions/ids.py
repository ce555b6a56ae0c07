"""Stable identifiers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ID_FIELDS = ("doi", "pm_id", "pmc_id", "gs_id", "extra_id")


def item_id(**columns: Column) -> Column:
    """SHA-256 of the given identifiers, in a fixed order, absent and empty ones left out; null if there is none."""
    parts = []
    for name in ID_FIELDS:
        if name in columns:
            c = columns[name].cast("string")
            parts.append(F.when(c.isNotNull() & (c != "") & (c != "0"), F.concat(F.lit(f"{name}:"), c)))
    text = F.concat_ws("|", *parts)
    return F.when(text != "", F.sha2(text, 256))


def triplet_id(node_1: Column, edge: Column, node_2: Column, metadata: Column, ordinal: Column) -> Column:
    """Unlike a memory address, the same on every run."""
    return F.sha2(F.concat_ws("\u0001", node_1, edge, node_2, F.to_json(metadata), ordinal.cast("string")), 256)


def compact(ident: Column) -> Column:
    """A triplet id in half its bytes, for joins; other ids in their own, with a mark so that no two ids share one."""
    digest = F.rlike(ident, F.lit("^[0-9a-f]{64}$"))
    return F.when(digest, F.unhex(F.concat(ident, F.lit("00")))).otherwise(F.encode(F.concat(ident, F.lit("\u0001")), "utf-8"))


def hypothesis_id(statement: Column) -> Column:
    return F.sha2(statement, 256)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True)


def subgraph_digest(start: str, end: str, path: list[str], extra: list[str]) -> str:
    """SHA-256 of the subgraph's canonical JSON, with both node lists sorted."""
    doc = {"start_node": start, "end_node": end, "path_nodes": sorted(path), "additional_nodes": sorted(extra)}
    return hashlib.sha256(canonical(doc).encode()).hexdigest()


def subgraph_id(start: Column, end: Column, path: Column, extra: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([subgraph_digest(a, b, list(p), list(x)) for a, b, p, x in zip(*columns, strict=True)])

    return run(start, end, path, extra)


def kg_version(kind: str, config: dict) -> str:
    """Name of a graph version that its configuration determines."""
    return f"{kind}_{hashlib.sha256(canonical(config).encode()).hexdigest()[:8]}"
