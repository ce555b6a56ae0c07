"""Column layouts that the operators exchange.

A graph is three DataFrames.  ``nodes`` and ``edges`` carry identity, domain tags and
attributes; ``sources`` is the provenance, one row per triplet occurrence, in long form, so a hub
with millions of occurrences is never one array.  Arrays are built only for export.
"""

from __future__ import annotations

MAP = "map<string,string>"
TRIPLET = f"triplet_ord bigint, node_1 string, edge string, node_2 string, metadata {MAP}"
NODE = f"id string, domains array<string>, attrs {MAP}"
EDGE = f"src string, relation string, dst string, domains array<string>, attrs {MAP}, ord bigint"
SOURCE = f"src string, relation string, dst string, triplet_id string, ord bigint, metadata {MAP}"
PATH = "path_id string, start string, end string, path array<string>"
CHUNK = "item_id string, pos int, chunk_id string, text string"
HYPOTHESIS = "title string, statement string, subgraph_id string, method string, references array<string>"
EMBEDDING = "text string, vec array<double>"
ITEM = "id string, doi string, pm_id bigint, pmc_id string, gs_id string, extra_id string, category string, title string, abstract string, gs_meta string, scraped_date string, authors array<string>"
EDGE_KEY = ("src", "relation", "dst")
