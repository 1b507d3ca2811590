"""Build-time checks of pipelines and of queries that are to be resumed: findings as text, nothing is run."""

from __future__ import annotations

import re

from .pipeline import ROUTE, SINK, SOURCE, Graph


def check_resumable(query: str, keys: tuple[str, ...] = ()) -> list[str]:
    """What stands in the way of resuming a query from a checkpoint: it must have an order, and a total one."""
    flat = re.sub(r"\([^()]*\)", " ", query)
    found = re.search(r"(?is)\border\s+by\s+(.+?)(?:\blimit\b|\boffset\b|$)", flat)
    if not found:
        return ["a query that is resumed needs ORDER BY, or rows are skipped or read twice"]
    columns = [re.split(r"\s+", c.strip())[0].split(".")[-1].strip('"`[]').lower() for c in found[1].split(",")]
    if keys and not set(map(str.lower, keys)) <= set(columns):
        return [f"ORDER BY {', '.join(columns)} does not hold the key {', '.join(keys)}, so rows with equal values have no fixed order"]
    return []


def check_graph(graph: Graph) -> list[str]:
    """Findings that are no errors: outputs nobody reads, nodes that hide failures, routes with one output."""
    out = []
    for name, node in graph.nodes.items():
        if node.kind not in (SINK,) and not graph.outputs(name):
            out.append(f"nothing reads what {name} gives")
        if node.options.get("or_schema") is not None and not node.options.get("restarts"):
            out.append(f"{name} is left out at its first failure, without a restart")
        if node.kind == ROUTE and len(node.work.outputs()) < 2:
            out.append(f"route {name} has one output only")
        if node.kind == SOURCE and len(graph.outputs(name)) > 1:
            out.append(f"source {name} is kept in storage while its {len(graph.outputs(name))} readers run")
    return out
