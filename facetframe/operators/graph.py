"""Transitive closure of pair tables: components by repeated smallest labels, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path, ship

#: Pairs that a task thins out at once.
HELD = 1 << 20


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a table in the shared checkpoint folder, which goes when the application ends."""
    at = shared_path(df.sparkSession, "graph")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _thinned(keys: list[str]):
    """A task's pairs (keys, x, y) to stars of the same components: the least node of each, and every other one."""

    def stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pairs = pd.concat(parts, ignore_index=True)
        ends = pd.concat([pairs[[*keys, c]].rename(columns={c: "node"}) for c in "xy"], ignore_index=True)
        at = ends.groupby([*keys, "node"], dropna=False).ngroup().to_numpy()
        first = np.zeros(at.max() + 1, np.int64)
        first[at] = np.arange(len(at))
        root = np.arange(len(first))
        u, v = at[: len(pairs)], at[len(pairs) :]
        while (apart := root[u] != root[v]).any():
            u, v = root[u[apart]], root[v[apart]]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root[root] != root).any():
                root = root[root]
        below = np.flatnonzero(root != np.arange(len(root)))
        out = ends.iloc[first[below]].rename(columns={"node": "y"}).reset_index(drop=True)
        return out.assign(x=ends["node"].to_numpy()[first[root[below]]])[[*keys, "x", "y"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch):
                parts.append(batch)
            if sum(map(len, parts)) >= HELD:
                yield stars(parts)
                parts = []
        if parts:
            yield stars(parts)

    return run


def composed(maps: list[DataFrame], keys: list[str]) -> DataFrame:
    """One map (keys, at, up) for ``maps`` that are taken one after the other; a node without an entry stays as it is.

    Made from the last to the first, so each join has the rows of one map and of those after it, and no round touches all nodes.
    """
    out = maps[-1]
    for first in reversed(maps[:-1]):
        then = out.select(*keys, F.col("at").alias("up"), F.col("up").alias("then"))
        moved = first.join(then, [*keys, "up"], "left").select(*keys, "at", F.coalesce("then", "up").alias("up"))
        out = moved.union(out.join(first.select(*keys, "at"), [*keys, "at"], "left_anti").select(*keys, "at", "up"))
    return out


def components(nodes: DataFrame, pairs: DataFrame, keys: list[str], node: str, a: str, b: str) -> DataFrame:
    """Component (its smallest node) of every node, within each key (a scene or a frame).

    Each task first thins its pairs to stars. Every round points each node to the first of itself and its neighbours and contracts the
    pairs to those, until none is left: first by number, which ends stars, then by a hash of the round, which shortens any graph by a share. Fewer pairs than
    ``HELD`` are ended by one task. All groups go on together.
    """
    ship(nodes.sparkSession)
    apart = pairs.where(F.col(a) != F.col(b)).select(*keys, F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    left = written(apart.mapInPandas(_thinned(keys), apart.schema).distinct())
    maps: list[DataFrame] = []
    while rows := left.count():
        if rows < HELD:  # as many as a task thins out at once, so one task ends it
            stars = written(left.coalesce(1).mapInPandas(_thinned(keys), left.schema))
            maps.append(stars.select(*keys, F.col("y").alias("at"), F.col("x").alias("up")))
            break
        ends = left.select(*keys, F.explode(F.array(*[F.struct(F.col(p).alias("at"), F.col(q).alias("other")) for p in "xy" for q in "xy"])).alias("e")).select(*keys, "e.*")
        order = F.xxhash64("other", F.lit(len(maps))) if maps else F.col("other")
        up = written(ends.groupBy(*keys, "at").agg(F.min_by("other", order).alias("up")))
        maps.append(up)
        of = lambda end: up.select(*keys, F.col("at").alias(end), F.col("up").alias(f"up_{end}"))  # noqa: B023, E731
        moved = left.join(of("x"), [*keys, "x"]).join(of("y"), [*keys, "y"]).where("up_x <> up_y")
        left = written(moved.select(*keys, F.least("up_x", "up_y").alias("x"), F.greatest("up_x", "up_y").alias("y")).distinct())
    every = nodes.select(*keys, node).distinct()
    if not maps:
        return every.withColumn("component", F.col(node))
    named = composed(maps, keys)
    if len(maps) > 1:  # the first round alone ends at the least node
        named = written(named)
        least = named.groupBy(*keys, "up").agg(F.least(F.min("at"), F.first("up")).alias("least"))
        named = named.join(least, [*keys, "up"]).select(*keys, "at", F.col("least").alias("up"))
    return every.join(named.withColumnRenamed("at", node), [*keys, node], "left").select(*keys, node, F.coalesce("up", node).alias("component"))


def pixel_components(px: DataFrame, mask: str = "connected", eight: bool = True) -> DataFrame:
    """Connected regions of a mask, numbered from 1 in each frame by their first pixel; 0 outside.

    Runs of a row are made first, so the graph has a node for each run and not for each pixel.
    """
    from pyspark.sql import Window

    frame = ["scene_id", "frame_id"]
    on = px.where(F.col(mask)).select(*frame, "v", "u")
    w = Window.partitionBy(*frame, "v").orderBy("u")
    run = on.withColumn("grp", F.col("u") - F.row_number().over(w))
    runs = run.groupBy(*frame, "v", "grp").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    runs = written(runs.withColumn("id", F.col("v").cast("long") * 1_000_000 + F.col("lo")))
    reach = 1 if eight else 0
    above = runs.select(*frame, (F.col("v") + 1).alias("v"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("id").alias("pid"))
    touch = runs.join(above, [*frame, "v"]).where((F.col("plo") <= F.col("hi") + reach) & (F.col("phi") >= F.col("lo") - reach)).select(*frame, "id", "pid")
    found = components(runs, touch, frame, "id", "id", "pid")
    numbers = found.select(*frame, "component").distinct().withColumn("region", F.row_number().over(Window.partitionBy(*frame).orderBy("component")))
    labelled = runs.join(found, [*frame, "id"]).join(numbers, [*frame, "component"]).select(*frame, "v", F.explode(F.sequence("lo", "hi")).alias("u"), "region")
    return px.select(*frame, "v", "u").join(labelled, [*frame, "v", "u"], "left").withColumn("region", F.coalesce("region", F.lit(0)))
