"""Hypotheses: generation contract, review loop, parsing, cost, rendering."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.functions import ids, text
from tessergraph.operators.resolve import asked
from tessergraph.runtime import saved


class Generator(Protocol):
    """Makes (subgraph_id, reply) of (subgraph_id, context)."""

    def run(self, subgraphs: DataFrame) -> DataFrame: ...


class ModelGenerator:
    def __init__(self, model: Callable[[str], str], method: str = "model"):
        self.model, self.method = model, method

    def run(self, subgraphs: DataFrame) -> DataFrame:
        return subgraphs.select("subgraph_id", asked(F.col("context"), self.model).alias("reply"))


def parsed(replies: DataFrame, method: str = "model") -> DataFrame:
    """The HYPOTHESIS layout and hypothesis_id of (subgraph_id, reply)."""
    r = F.col("reply")
    own = F.coalesce(F.nullif(text.statement(r), F.lit("")), r)
    return replies.select(text.title(r, F.concat(F.lit("Hypothesis for "), "subgraph_id")).alias("title"), own.alias("statement"), "subgraph_id", F.lit(method).alias("method"), text.references(r).alias("references"), ids.hypothesis_id(own).alias("hypothesis_id"))


def improve(start: DataFrame, generate: Callable[[str], str], critics: dict[str, Callable[[str], str]], critique: Callable[[str], str], refine: Callable[[str], str], limit: int = 3) -> DataFrame:
    """The agent loop as rounds over a table (subgraph_id, context): every open hypothesis is seen by all critics, then accepted or refined.

    Result: (subgraph_id, hypothesis, decision, iterations). Rounds end when all are accepted or the limit is passed.
    """
    state, _ = saved(start.select("subgraph_id", "context", asked(F.col("context"), generate).alias("hypothesis"), F.lit("").alias("decision"), F.lit(0).alias("iterations")), "hyp")
    for _ in range(limit + 1):
        open_ = state.where("decision <> 'ACCEPT'")
        views = [F.concat(F.lit(f"{name}: "), asked(F.col("hypothesis"), m)) for name, m in critics.items()]
        seen = open_.withColumn("views", F.concat_ws("\n", *views))
        judged = seen.withColumn("verdict", asked(F.concat("hypothesis", F.lit("\n"), "views"), critique)).withColumn("decision", text.decision(F.col("verdict")))
        refined = F.when(F.col("decision") == "ACCEPT", F.col("hypothesis")).otherwise(asked(F.concat("hypothesis", F.lit("\n"), "verdict"), refine))
        moved = judged.withColumn("hypothesis", refined).withColumn("iterations", F.col("iterations") + 1).select(*state.columns)
        state, _ = saved(state.where("decision = 'ACCEPT'").unionByName(moved), "hyp")
        if state.where("decision <> 'ACCEPT'").isEmpty():
            break
    return state.select("subgraph_id", "hypothesis", "decision", "iterations")


def cost(messages: DataFrame) -> DataFrame:
    """(conversation, cost) of messages (conversation, model, tokens_in, tokens_out): each rounded to four places, then summed."""
    return messages.groupBy("conversation").agg(F.round(F.sum(text.message_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))), 4).alias("cost"))


def as_json(h: DataFrame) -> DataFrame:
    return h.select("hypothesis_id", F.to_json(F.struct("title", F.col("statement").alias("text"), "hypothesis_id", "subgraph_id", "method", "references")).alias("body"))


def as_markdown(h: DataFrame) -> DataFrame:
    """Title, statement and numbered references."""
    refs = F.array_join(F.transform("references", lambda r, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), r)), "\n")
    return h.select("hypothesis_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "statement", F.when(F.size("references") > 0, F.concat(F.lit("\n\n## References\n"), refs)).otherwise(F.lit(""))).alias("body"))
