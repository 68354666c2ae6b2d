"""A small lazy pipeline: nodes name a stage, inputs and outputs; DataFrames flow, files only where declared."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, Mapping[str, DataFrame], Mapping], Mapping[str, DataFrame]]


@dataclass(frozen=True)
class Node:
    key: str
    stage: str
    inputs: Mapping[str, str] = field(default_factory=dict)
    outputs: Mapping[str, str | None] = field(default_factory=dict)
    settings: Mapping = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pipeline:
    sources: Mapping[str, str]
    nodes: tuple[Node, ...]

    @classmethod
    def from_dict(cls, spec: Mapping) -> "Pipeline":
        nodes = tuple(Node(k, n["stage"], n.get("inputs", {}), n.get("outputs", {}), n.get("settings", {}), tuple(n.get("depends_on", ()))) for k, n in spec.get("nodes", {}).items())
        return cls(dict(spec.get("sources", {})), nodes)

    def needs(self, node: Node) -> set[str]:
        """Nodes that must run first; an input is a source or ``node.output``."""
        out = set(node.depends_on)
        for ref in node.inputs.values():
            if ref not in self.sources:
                out.add(ref.rpartition(".")[0])
        return out

    def order(self) -> list[Node]:
        """Topological, in the order given where free; unknown references and cycles raise."""
        by_key = {n.key: n for n in self.nodes}
        for n in self.nodes:
            if unknown := self.needs(n) - set(by_key):
                raise ValueError(f"{n.key} depends on unknown {sorted(unknown)}")
        done: list[Node] = []
        left = list(self.nodes)
        while left:
            ready = next((n for n in left if self.needs(n) <= {d.key for d in done}), None)
            if ready is None:
                raise ValueError(f"cycle among {[n.key for n in left]}")
            done.append(ready)
            left.remove(ready)
        return done


class Registry:
    """Stages by name."""

    def __init__(self):
        self.stages: dict[str, Stage] = {}

    def stage(self, name: str) -> Callable[[Stage], Stage]:
        def add(f: Stage) -> Stage:
            if name in self.stages:
                raise ValueError(f"stage {name} exists")
            self.stages[name] = f
            return f

        return add

    def run(self, spark: SparkSession, pipeline: Pipeline, overrides: Mapping[str, Mapping] | None = None) -> dict[str, DataFrame]:
        """Every artifact by name. Outputs with a path are written and read back, the others stay plans."""
        made: dict[str, DataFrame] = {k: spark.read.parquet(p) for k, p in pipeline.sources.items()}
        for node in pipeline.order():
            if node.stage not in self.stages:
                raise ValueError(f"{node.key}: no stage {node.stage}")
            got = self.stages[node.stage](spark, {k: made[ref] for k, ref in node.inputs.items()}, {**node.settings, **(overrides or {}).get(node.key, {})})
            for name, path in node.outputs.items():
                df = got[name]
                if path:
                    df.write.mode("overwrite").parquet(path)
                    df = spark.read.parquet(path)
                made[f"{node.key}.{name}"] = df
        return made
