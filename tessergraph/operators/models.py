"""Models by name, prompt templates, and the longer review loop.

A model is any callable text -> text (or an object with ``content``). Callables run on executors, so they must pickle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.functions import text
from tessergraph.operators import hypothesis
from tessergraph.operators.resolve import asked
from tessergraph.runtime import saved

Model = Callable[[str], str]


class Models:
    """A registry; an unknown name is a ValueError."""

    def __init__(self, default: str | None = None, **models: Model):
        self.models, self.default = dict(models), default

    def register(self, name: str, model: Model) -> None:
        self.models[name] = model
        self.default = self.default or name

    def get(self, name: str | None = None) -> Model:
        wanted = name or self.default
        if wanted not in self.models:
            raise ValueError(f"unknown model {wanted!r}; known: {', '.join(sorted(self.models)) or 'none'}")
        return self.models[wanted]


class Prompts:
    """Templates with {placeholders} by name, from a dict or a YAML file of name: text."""

    def __init__(self, templates: dict[str, str]):
        self.templates = templates

    @classmethod
    def from_yaml(cls, path: str) -> Prompts:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading prompts from YAML needs PyYAML") from e
        with open(path) as f:
            return cls(yaml.safe_load(f) or {})

    def get(self, name: str, **values) -> str:
        if name not in self.templates:
            raise ValueError(f"no prompt named {name!r}")
        return self.templates[name].format(**values)

    def column(self, name: str, **columns):
        """The template as a column expression: placeholders are filled with columns, in the JVM."""
        import string

        if name not in self.templates:
            raise ValueError(f"no prompt named {name!r}")
        parts = []
        for literal, key, _, _ in string.Formatter().parse(self.templates[name]):
            parts += [F.lit(literal)] if literal else []
            parts += [F.coalesce(columns[key].cast("string"), F.lit(""))] if key is not None else []
        return F.concat(*parts)


def novel(start: DataFrame, generate: Model, judge: Model, limit: int = 4) -> DataFrame:
    """(subgraph_id, context, hypothesis, tries): generate again, told why, until the judge accepts or the tries are used up."""
    state, _ = saved(start.select("subgraph_id", "context", F.lit(None).cast("string").alias("hypothesis"), F.lit("").alias("told"), F.lit(0).alias("tries"), F.lit(False).alias("done")), "novel")
    for _ in range(limit):
        fresh = state.where("NOT done").withColumn("hypothesis", asked(F.concat("context", F.lit("\n"), "told"), generate))
        fresh, _ = saved(fresh, "novel")
        fresh = fresh.withColumn("told", asked(F.col("hypothesis"), judge)).withColumn("tries", F.col("tries") + 1).withColumn("done", text.decision(F.col("told")) == "ACCEPT")
        state, _ = saved(state.where("done").unionByName(fresh.select(*state.columns)), "novel")
        if state.where("NOT done").isEmpty():
            break
    return state.select("subgraph_id", "context", "hypothesis", "tries")


def reviewed(start: DataFrame, generate: Model, novelty: Model, method: Model, reviewers: dict[str, Model], summarise: Model, refine: Model, novelty_limit: int = 4, limit: int = 2) -> DataFrame:
    """The longer loop: a novelty loop, a methodology for each hypothesis, reviewers of both, a summary that accepts or refines."""
    first = novel(start, generate, novelty, novelty_limit)
    planned, _ = saved(first.select("subgraph_id", F.concat("hypothesis", F.lit("\nMethod: "), asked(F.col("hypothesis"), method)).alias("context")), "planned")
    return hypothesis.improve(planned, _same, reviewers, summarise, refine, limit)


def _same(x: str) -> str:
    return x
