"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups are dealt to buckets by a hash; each bucket is differenced in a task of its own to a partial partition, a tuple of
shard sums. Those tuples are differenced in turn, some hundred to a task, until one is left. Only sums climb the tree.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._common import cut, forget, small


@dataclass(frozen=True)
class Shards:
    """``groups``: differenced in one task, about; ``fan_in``: partial partitions combined in one task; ``chunk``: rows numbered in one task."""

    shards: int = 8
    groups: int = 20_000
    fan_in: int = 512
    chunk: int = 4_000


def difference(parts: list[list[tuple[int, object]]]) -> list[tuple[int, object]]:
    """Karmarkar-Karp: combines the two partial partitions of largest spread, oppositely ordered, until one is left.

    A partial partition is a list of (sum, members), one for each shard; members are leaves or pairs of members.
    Returns the final one, largest sum first. Ties are broken by the order of ``parts``.
    """
    heap = []
    for k, part in enumerate(parts):
        part = sorted(part, key=lambda x: -x[0])
        heap.append((part[-1][0] - part[0][0], k, part))
    heapq.heapify(heap)
    k = len(parts)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        spread, _, b = heap[0]
        joined = [(x + y, m if n is None else n if m is None else (m, n)) for (x, m), (y, n) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda x: -x[0])
        heapq.heapreplace(heap, (joined[-1][0] - joined[0][0], k, joined))
        k += 1
    return heap[0][2]


def _leaves(members: object) -> list:
    out, open_ = [], [members] if members is not None else []
    while open_:
        x = open_.pop()
        if isinstance(x, tuple):
            open_ += x
        else:
            out.append(x)
    return out


def _bucket(shards: int):
    """Groups (h1, h2, weight) of a bucket to their shard in its own partial partition."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("weight", "descending"), ("h1", "ascending"), ("h2", "ascending")])
        empty = [(0, None)] * (shards - 1)
        final = difference([[(w, k), *empty] for k, w in enumerate(rows.column("weight").to_pylist())])
        own = [0] * rows.num_rows
        for shard, (_, members) in enumerate(final):
            for k in _leaves(members):
                own[k] = shard
        return rows.select(["h1", "h2", "bucket", "weight"]).append_column("slot", pa.array(own, pa.int32()))

    return run


def _level(shards: int):
    """Partial partitions (node, slot, weight) below one parent to the slots of their combination."""

    def run(rows: pa.Table) -> pa.Table:
        parts: dict[int, dict[int, int]] = {}
        for node, slot, weight in zip(*(rows.column(c).to_pylist() for c in ("node", "slot", "weight")), strict=True):
            parts.setdefault(node, {})[slot] = weight
        final = difference([[(own.get(s, 0), node * shards + s) for s in range(shards)] for node, own in sorted(parts.items())])
        out = [(k // shards, k % shards, shard) for shard, (_, members) in enumerate(final) for k in _leaves(members)]
        node, slot, up = zip(*out, strict=True)
        return pa.table({"node": pa.array(node, pa.int64()), "slot": pa.array(slot, pa.int32()), "up": pa.array(up, pa.int32())})

    return run


def byte_balanced(docs: DataFrame, p: Shards = Shards()) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) of every row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. size is the text's UTF-8 bytes plus 1; a null text counts as
    an empty one. Equal texts are one group and share a shard. slot numbers the rows of a shard from 0 without gaps,
    repeated rows each with their own. Ties between groups go by their hashes, so equal input gives equal shards. An empty
    table gives an empty table.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")))
    rows = base.count()
    nodes = max(1, ceil(rows / p.groups))
    groups = base.groupBy("h1", "h2").agg(F.sum("size").alias("weight")).withColumn("bucket", F.pmod(F.col("h1"), F.lit(nodes)).cast("long"))
    local = cut(groups.groupBy("bucket").applyInArrow(_bucket(p.shards), "h1 long, h2 long, bucket long, weight long, slot int"))
    way = local.groupBy("bucket", "slot").agg(F.sum("weight").alias("weight")).select("bucket", F.col("slot").alias("leaf"), F.col("bucket").alias("node"), "slot", "weight")
    while nodes > 1:
        sums = way.groupBy("node", "slot").agg(F.sum("weight").alias("weight")).withColumn("parent", F.floor(F.col("node") / p.fan_in))
        up = sums.groupBy("parent").applyInArrow(_level(p.shards), "node long, slot int, up int")
        way = cut(way.join(up, ["node", "slot"]).select("bucket", "leaf", F.floor(F.col("node") / p.fan_in).alias("node"), F.col("up").alias("slot"), "weight"))
        nodes = ceil(nodes / p.fan_in)
    way = cut(way.select("bucket", F.col("leaf").alias("leaf"), F.col("slot").alias("shard")))
    shard_of = local.withColumnRenamed("slot", "leaf").join(small(way, way.count()), ["bucket", "leaf"]).select("h1", "h2", "shard")
    chunks = max(1, ceil(rows / p.chunk))
    placed = cut(base.join(shard_of, ["h1", "h2"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))))
    before = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).drop("n")
    at = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "h1", "h2"))
    slotted = placed.withColumn("at", at).join(small(before, chunks * p.shards), ["shard", "chunk"])
    forget(local)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
