"""A builder for layered pipelines: stages of operators, each a function of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame

Operator = Callable[[DataFrame], DataFrame]


class Strategy(Enum):
    """How rows reach an operator: as they are, by key, in turn, or all of them.

    Every operator below reads all rows of those above, each from a branch of its own, so BROADCAST deals nothing anew.
    """

    FORWARD = "forward"
    HASH = "hash"
    ROUND_ROBIN = "round_robin"
    BROADCAST = "broadcast"


@dataclass
class _Node:
    name: str
    stage: int
    operator: Operator
    strategy: Strategy
    parallelism: int | None
    keys: tuple[str, ...]
    below: list[str] = field(default_factory=list)


class QueryPlan:
    """Operators by stage. Every operator feeds all of the next stage unless its edges are given.

    Spark plans and places the work. ``parallelism`` is the number of partitions that rows are dealt to, where a strategy
    deals them; several inputs of an operator are united by column name.
    """

    def __init__(self):
        self.nodes: dict[str, _Node] = {}

    def add_stage(self, stage: int, *operators: Operator, strategy: Strategy = Strategy.FORWARD, parallelism: int | None = None, keys: tuple[str, ...] = (), name: str | None = None) -> list[str]:
        """Returns the names of the operators added."""
        if strategy is Strategy.HASH and not keys:
            raise ValueError("hash dealing needs keys")
        names = []
        for op in operators:
            base = name or getattr(op, "__name__", type(op).__name__)
            unique = f"{base}_{sum(n.name.rsplit('_', 1)[0] == base for n in self.nodes.values()) + 1}"
            self.nodes[unique] = _Node(unique, stage, op, strategy, parallelism, keys)
            names.append(unique)
        return names

    def add_downstream(self, above: str, below: str) -> QueryPlan:
        if self.nodes[below].stage <= self.nodes[above].stage:
            raise ValueError(f"{below} is not below {above}")
        self.nodes[above].below.append(below)
        return self

    def build(self, source: DataFrame) -> dict[str, DataFrame]:
        """The outputs of the operators that feed no other, by name."""
        stages = sorted({n.stage for n in self.nodes.values()})
        following = dict(zip(stages, stages[1:], strict=False))
        inputs: dict[str, list[DataFrame]] = {n.name: [source] for n in self.nodes.values() if stages and n.stage == stages[0]}
        out: dict[str, DataFrame] = {}
        for node in sorted(self.nodes.values(), key=lambda n: n.stage):
            if node.name not in inputs:
                continue  # nothing feeds it
            got = reduce(DataFrame.unionByName, inputs[node.name])
            if node.strategy is Strategy.HASH:
                got = got.repartition(node.parallelism, *node.keys) if node.parallelism else got.repartition(*node.keys)
            elif node.strategy is Strategy.ROUND_ROBIN:
                got = got.repartition(node.parallelism or got.sparkSession.sparkContext.defaultParallelism)
            made = node.operator(got)
            below = node.below or [n.name for n in self.nodes.values() if n.stage == following.get(node.stage)]
            if not below:
                out[node.name] = made
            for name in below:
                inputs.setdefault(name, []).append(made)
        return out
