"""Closures over graphs that are keyed by project.

Projects are small and many, so each is closed in one group. A project with more
than GROUP_EDGES edges is closed by doubling paths instead, a few joins for any
diameter. Cycles take one linear pass over a project.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.sources.store import forget, written


#: Edges of a project up to which one task closes it.
GROUP_EDGES = 100_000


def _reach(edges: dict[int, list[int]], start: int) -> set[int]:
    seen: set[int] = set()
    rest = list(edges.get(start, ()))
    while rest:
        x = rest.pop()
        if x not in seen:
            seen.add(x)
            rest += edges.get(x, ())
    return seen


def _adjacent(rows: pd.DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for a, b in zip(rows["source"].tolist(), rows["target"].tolist()):
        out.setdefault(a, []).append(b)
    return out


def reachable_pairs(edges: DataFrame, *, start: bool = False, most: int = GROUP_EDGES) -> DataFrame:
    """(project_id, source, target) of all nodes reachable from a source.

    The source itself is left out, even on a cycle, unless ``start``. Projects of
    more than ``most`` edges are closed by joins.
    """
    edges = edges.select("project_id", F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"))
    large = edges.groupBy("project_id").count().where(F.col("count") > most).select("project_id")
    if not large.isEmpty():
        wide = doubled_pairs(edges.join(large, "project_id", "left_semi"), keys=("project_id",))
        wide = wide if start else wide.where("source <> target")
        return reachable_pairs(edges.join(large, "project_id", "left_anti"), start=start, most=1 << 62).unionByName(wide)

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        adjacent = _adjacent(rows)
        project = rows["project_id"].iloc[0]
        out = [(project, a, b) for a in sorted(adjacent) for b in sorted(_reach(adjacent, a)) if start or a != b]
        return pd.DataFrame(out, columns=["project_id", "source", "target"])

    return edges.select("project_id", "source", "target").groupBy("project_id").applyInPandas(close, "project_id long, source int, target int")


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(project_id, members) of each set of mutually reachable nodes, and of single nodes with a loop; nodes in their own order."""

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        found = _components(_adjacent(rows))
        project = rows["project_id"].iloc[0]
        return pd.DataFrame({"project_id": pd.Series([project] * len(found), dtype="int64"), "members": pd.Series(found, dtype=object)})

    return edges.select("project_id", "source", "target").groupBy("project_id").applyInPandas(close, "project_id long, members array<int>")


def _components(adjacent: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected sets that hold a cycle, by one depth-first pass with low marks, in order of their least node."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    waiting: set[int] = set()
    found = []
    for start in sorted(adjacent):
        if start in number:
            continue
        trail = [(start, iter(sorted(adjacent[start])))]
        number[start] = low[start] = len(number)
        stack.append(start)
        waiting.add(start)
        while trail:
            node, rest = trail[-1]
            child = next(rest, None)
            if child is None:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        waiting.discard(members[-1])
                    if len(members) > 1 or node in adjacent.get(node, ()):
                        found.append(sorted(members))
            elif child not in number:
                number[child] = low[child] = len(number)
                stack.append(child)
                waiting.add(child)
                trail.append((child, iter(sorted(adjacent.get(child, ())))))
            elif child in waiting:
                low[node] = min(low[node], number[child])
    return sorted(found)


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(project_id, source, target, distance, path) of every node reachable from a source; of equal paths the least."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        adjacent = _adjacent(rows)
        project = rows["project_id"].iloc[0]
        out = []
        for start in sorted(adjacent):
            paths, layer = {start: [start]}, [start]
            while layer:
                following = []
                for node in layer:  # in order of their paths, so the first that reaches a node has the least
                    for child in sorted(set(adjacent.get(node, ()))):
                        if child not in paths:
                            paths[child] = [*paths[node], child]
                            following.append(child)
                layer = following
            out += [(project, start, end, len(path) - 1, path) for end, path in sorted(paths.items()) if end != start]
        return pd.DataFrame(out, columns=["project_id", "source", "target", "distance", "path"])

    return edges.select("project_id", "source", "target").groupBy("project_id").applyInPandas(search, "project_id long, source int, target int, distance int, path array<int>")


def doubled_pairs(edges: DataFrame, *, keys: tuple[str, ...] = (), rounds: int = 40) -> DataFrame:
    """All (source, target) paths of large graphs, told apart by ``keys``, by joining paths to paths until none is new.

    Each round is a written table in ``spark.checkpoint.dir``; the one before it
    is deleted.
    """
    spark = edges.sparkSession
    paths, place = written(edges.select(*keys, "source", "target").distinct(), "paths")
    size = paths.count()
    for _ in range(rounds):
        longer = paths.join(paths.select(*keys, F.col("source").alias("target"), F.col("target").alias("end")), [*keys, "target"]).select(*keys, "source", F.col("end").alias("target"))
        before = place
        paths, place = written(paths.unionByName(longer).distinct(), "paths")
        forget(spark, before)
        if (now := paths.count()) == size:
            return paths
        size = now
    raise RuntimeError("the closure did not settle")
