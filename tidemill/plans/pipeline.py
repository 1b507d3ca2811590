"""A pipeline: a graph of named nodes whose edges carry DataFrames.

Nodes only build plans; nothing runs until the sinks do, in topological order. The graph is
checked before that: names, edges, sources, sinks, reachability, loops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.routing import Router, concatenate
from .resilience import or_empty, restarted

SOURCE, TRANSFORM, JOIN, MERGE, ROUTE, SINK = "source", "transform", "join", "merge", "route", "sink"


@dataclass
class Context:
    """What a run carries besides data: the session, parameters, and a scratch pad for nodes."""

    spark: SparkSession
    parameters: dict[str, Any] = field(default_factory=dict)
    items: dict[str, Any] = field(default_factory=dict)

    def child(self, inherit_parameters: bool = True, inherit_items: bool = False) -> Context:
        """A context for a nested pipeline."""
        return Context(self.spark, dict(self.parameters) if inherit_parameters else {}, dict(self.items) if inherit_items else {})


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    work: Callable
    options: dict = field(default_factory=dict)

    def made(self, context: Context, came: list) -> Any:
        """What the node gives for its inputs."""
        if self.kind == SOURCE:
            build = lambda: self.work(context)
        elif self.kind == JOIN:
            build = lambda: self.work(*came)
        elif self.kind == ROUTE:
            return self.work.split(_one(came))
        elif self.kind == MERGE:
            build = lambda: self.work(came)
        elif self.options.get("in_context"):
            build = lambda: self.work(_one(came), context)
        else:
            build = lambda: self.work(_one(came))
        restarts, instead = self.options.get("restarts", 0), self.options.get("or_schema")
        work = (lambda: restarted(build, restarts)) if restarts else build
        if instead is not None:
            return or_empty(work, instead, context.spark)
        return work()


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    port: str | None = None


class GraphError(ValueError):
    """A graph that cannot run; `problems` lists all that was found."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = list(problems)


@dataclass(frozen=True)
class Graph:
    nodes: dict[str, Node]
    edges: tuple[Edge, ...]

    def inputs(self, name: str) -> list[Edge]:
        return [e for e in self.edges if e.target == name]

    def outputs(self, name: str) -> list[Edge]:
        return [e for e in self.edges if e.source == name]

    def order(self) -> list[str]:
        """Names such that every node follows its inputs; in order of addition where that leaves a choice."""
        waiting = {n: len(self.inputs(n)) for n in self.nodes}
        ready, out = [n for n, k in waiting.items() if not k], []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for e in self.outputs(n):
                waiting[e.target] -= 1
                if not waiting[e.target]:
                    ready.append(e.target)
        if len(out) < len(self.nodes):
            raise GraphError([f"a loop runs through {sorted(set(self.nodes) - set(out))}"])
        return out

    def mermaid(self) -> str:
        shape = {SOURCE: "([{}])", SINK: "[/{}/]", JOIN: "{{{{{}}}}}", ROUTE: "{{{}}}"}
        lines = ["graph TD"]
        lines += [f"    {n.name}{shape.get(n.kind, '[{}]').format(n.name)}" for n in self.nodes.values()]
        lines += [f"    {e.source} -->{f'|{e.port}|' if e.port else ''} {e.target}" for e in self.edges]
        return "\n".join(lines)

    def describe(self) -> str:
        return "\n".join(f"{n.name} ({n.kind})" + "".join(f"\n  -> {e.target}" + (f" [{e.port}]" if e.port else "") for e in self.outputs(n.name)) for n in self.nodes.values())

    def run(self, context: Context) -> dict[str, Any]:
        """Builds all plans and runs the sinks; returns what the sinks return.

        A dataset that several nodes take is computed once and kept until the sinks are done. A
        node with restarts or a substitute schema (see Pipeline.transform) is computed at once.
        """
        made: dict[str, Any] = {}
        results = {}
        kept: list[DataFrame] = []
        try:
            for name in self.order():
                node = self.nodes[name]
                came = []
                for e in self.inputs(name):
                    x = made[e.source]
                    came.append(x[e.port] if isinstance(x, dict) else x)
                if node.kind == SINK:
                    results[name] = node.work(_one(came))
                    continue
                out = node.made(context, came)
                if isinstance(out, DataFrame) and len(self.outputs(name)) > 1:
                    out = out.persist()
                    kept.append(out)
                made[name] = out
        finally:
            for df in kept:
                df.unpersist()
        return results


def _one(frames: list[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else concatenate(*frames)


class Pipeline:
    """Builds a Graph."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.edges: list[Edge] = []

    def _add(self, name: str, kind: str, work: Callable, **options) -> Pipeline:
        self.nodes.append(Node(name, kind, work, options))
        return self

    def source(self, name: str, read: Callable[[Context], DataFrame]) -> Pipeline:
        return self._add(name, SOURCE, read)

    def transform(self, name: str, f: Callable[[DataFrame], DataFrame], restarts: int = 0, or_schema: Any = None) -> Pipeline:
        """Any step from one dataset to one dataset: map, filter, aggregate, batch, lookup, enrich.

        restarts: how often the step is built and computed again if it fails. or_schema: go on
        without the node if it still fails, with an empty dataset of this schema.
        """
        return self._add(name, TRANSFORM, f, **({"restarts": restarts} if restarts else {}), **({"or_schema": or_schema} if or_schema is not None else {}))

    def join(self, name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Pipeline:
        """Inputs arrive in the order of their edges: left, then right."""
        return self._add(name, JOIN, f)

    def merge(self, name: str, f: Callable[[list[DataFrame]], DataFrame]) -> Pipeline:
        return self._add(name, MERGE, f)

    def route(self, name: str, router: Router) -> Pipeline:
        return self._add(name, ROUTE, router)

    def composite(self, name: str, child: Callable[[DataFrame, Context], DataFrame], inherit_parameters: bool = True, inherit_items: bool = False) -> Pipeline:
        """A nested pipeline as one step; it gets a context of its own with what it inherits."""
        return self._add(name, TRANSFORM, lambda df, context: child(df, context.child(inherit_parameters, inherit_items)), in_context=True)

    def sink(self, name: str, write: Callable[[DataFrame], Any]) -> Pipeline:
        return self._add(name, SINK, write)

    def connect(self, *names: str, port: str | None = None) -> Pipeline:
        """Edges along a chain of names; `port` names the output of a route that the first edge takes."""
        for i, (a, b) in enumerate(zip(names, names[1:])):
            self.edges.append(Edge(a, b, port if i == 0 else None))
        return self

    def build(self) -> Graph:
        problems = []
        names = [n.name for n in self.nodes]
        problems += [f"node {n} is named twice" for n in sorted({n for n in names if names.count(n) > 1})]
        known = {n.name: n for n in self.nodes}
        problems += [f"an edge names {x}, which is no node" for e in self.edges for x in (e.source, e.target) if x not in known]
        problems += [f"node {e.source} is connected to itself" for e in self.edges if e.source == e.target]
        problems += [f"edge {e.source} to {e.target} is there twice" for e in sorted(set(self.edges), key=str) if self.edges.count(e) > 1]
        kinds = [n.kind for n in self.nodes]
        problems += [f"there is no {k}" for k in (SOURCE, SINK) if k not in kinds]
        if problems:
            raise GraphError(problems)
        graph = Graph(known, tuple(self.edges))
        for n in self.nodes:
            k = len(graph.inputs(n.name))
            if n.kind == SOURCE and k:
                problems.append(f"source {n.name} has an input")
            if n.kind != SOURCE and not k:
                problems.append(f"node {n.name} has no input")
            if n.kind == JOIN and k != 2:
                problems.append(f"join {n.name} has {k} inputs, not 2")
            if n.kind == SINK and graph.outputs(n.name):
                problems.append(f"sink {n.name} has an output")
            if n.kind == ROUTE:
                ports = [e.port for e in graph.outputs(n.name)]
                problems += [f"route {n.name} has an edge without an output it knows: {p}" for p in ports if p not in n.work.outputs()]
                problems += [f"output {o} of route {n.name} is not connected" for o in n.work.outputs() if o not in ports]
        reached, more = set(), [n.name for n in self.nodes if n.kind == SOURCE]
        while more:
            n = more.pop()
            if n not in reached:
                reached.add(n)
                more += [e.target for e in graph.outputs(n)]
        problems += [f"node {n} cannot be reached from a source" for n in known if n not in reached]
        if problems:
            raise GraphError(problems)
        graph.order()
        return graph
