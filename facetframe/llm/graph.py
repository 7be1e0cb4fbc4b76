"""Connected components of an edge table as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import trimmed
from ._common import counted, cut, forget, rows_of

#: Edges that a task thins out, or ends, at once (16 MB).
HELD = 1 << 20


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the same components: every node but the least of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[u] != root[v]).any():
        u, v = root[u[apart]], root[v[apart]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[below]], nodes[below]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges to as many as it has nodes at most."""

    def held() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))], names=["a", "b"])

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            parts.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(x) for x, _ in parts) >= HELD:
            yield held()
            parts = []
    if parts:
        yield held()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of every node of the edges, ``HELD`` of them at most."""
    parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        root, below = _forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        tops = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([below, tops])), pa.array(np.concatenate([root, tops]))], names=["node", "component"])


def composed(maps: list[DataFrame]) -> DataFrame:
    """One map (node, component) for ``maps`` that are taken one after the other; a node without an entry stays as it is.

    It is made from the last to the first, so each join has the rows of one map and of those after it.
    """
    out = maps[-1]
    for first in reversed(maps[:-1]):
        then = out.select(F.col("node").alias("component"), F.col("component").alias("then"))
        moved = first.join(then, "component", "left").select("node", F.coalesce("then", "component").alias("component"))
        out = moved.union(out.join(first.select("node"), "node", "left_anti").select("node", "component"))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", held: int = HELD) -> DataFrame:
    """(node, component) of every node of ``edges`` that has another; the component is its smallest node.

    Each task first thins its edges to stars. Each round then points every node to the first of itself and its neighbours, and
    contracts the edges to those, until ``held`` are left at most, which one task ends. The first round takes the smallest node,
    which ends stars; the others take a hash of their own, so a share of the nodes goes in each on any graph, long paths too.
    Nulls and loops are ignored, repeated edges do no harm, and an empty table gives an empty table.
    """
    ship(edges.sparkSession)
    low, high = F.least(a, b), F.greatest(a, b)
    apart = edges.where(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b"))
    left = counted(apart.mapInArrow(trimmed(_thinned), "a long, b long").distinct())
    steps = []
    while rows_of(left) > held:
        ends = left.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x in "ab" for y in "ab"])).alias("e")).select("e.*")
        order = F.xxhash64("other", F.lit(len(steps))) if steps else F.col("other")
        up = cut(ends.groupBy("node").agg(F.min_by("other", order).alias("component")))
        steps.append(up)
        of = lambda end: up.select(F.col("node").alias(end), F.col("component").alias(f"up_{end}"))  # noqa: B023, E731
        moved = left.join(of("a"), "a").join(of("b"), "b").where("up_a <> up_b")
        shorter = counted(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        forget(left)
        left = shorter
    if rows_of(left) or not steps:
        steps.append(counted(left.coalesce(1).mapInArrow(trimmed(_ended), "node long, component long")))
    forget(left)
    if len(steps) == 1:
        return steps[0]
    labels = composed(steps)
    # the first map alone ends at the smallest node
    labels = counted(labels.join(labels.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component")))
    forget(*steps)
    return labels
