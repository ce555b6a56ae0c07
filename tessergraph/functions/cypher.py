"""Cypher text of names, edges and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(name: Column) -> Column:
    """Names with blanks, commas, dashes or brackets go between back-ticks."""
    return F.when(name.rlike(r"[ \-,()\[\]{}]"), F.concat(F.lit("`"), name, F.lit("`"))).otherwise(name)


def edge_text(src: Column, relation: Column, dst: Column) -> Column:
    return F.concat(F.lit("("), escaped(src), F.lit(")-[:"), escaped(relation), F.lit("]->("), escaped(dst), F.lit(")"))


def triplet_text(node_1: Column, edge: Column, node_2: Column) -> Column:
    return F.concat(F.lit("("), node_1, F.lit(")-["), edge, F.lit("]->("), node_2, F.lit(")"))


def path_text(path: Column) -> Column:
    return F.array_join(path, " -> ")


def joined(texts, order, separator: str = ",\n") -> Column:
    """Aggregate: texts in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(texts).alias("_text")))), lambda x: x["_text"]), separator)
