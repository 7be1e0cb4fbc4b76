"""Merkle manifest of a dataset: digests of rows, trees over them, a proof for every row.

Rows are numbered within their key by ranges of the order. Each node's digest is an event: it enters the partial parent that
accumulates its children by their index, and a parent that has as many as the size of its level asks for becomes an event
itself. A task first combines what it holds; the children of parents that it could not fill, some at either end of its
run, reshuffle to where those of the same ancestor meet. Paths come back from the root along the reverse links, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import trimmed
from ._common import crc_mod, cut, forget, small


@dataclass(frozen=True)
class Merkle:
    """``arity``: children of a node. ``levels``: levels that one round climbs; a block is the subtree of a node so far up."""

    arity: int = 2
    levels: int = 10

    @property
    def span(self) -> int:
        return self.arity**self.levels

    def width(self, size: int, level: int) -> int:
        """Nodes of a level in a tree over ``size`` leaves."""
        return -(-size // self.arity**level)

    def height(self, size: int) -> int:
        level = 0
        while self.width(size, level) > 1:
            level += 1
        return level

    def rounds(self, size: int) -> int:
        return max(1, -(-self.height(size) // self.levels))


def digest(parts: Iterator[str] | list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give; a path has, level by level, what stands left and what stands right of the node."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest([left, leaf, right])
    return leaf


_NODE = "key string, size long, level int, at long, digest string, done boolean"


def _climb(goal: int, p: Merkle):
    """Events (key, size, level, at, digest) to nodes of level ``goal`` or their key's root, or else the unresolved ones."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "size", "level", "at", "digest", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple[str, int, int, int], dict[int, str]] = {}
        tops: dict[int, int] = {}
        for batch in batches:
            out = []
            for key, size, level, at, held in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "level", "at", "digest")), strict=True):
                if size not in tops:
                    tops[size] = min(goal, p.height(size))
                while level < tops[size]:
                    parent = (key, size, level + 1, at // p.arity)
                    children = partial.setdefault(parent, {})
                    children[at % p.arity] = held
                    if len(children) < min(p.arity, p.width(size, level) - parent[3] * p.arity):
                        break
                    del partial[parent]
                    level, at, held = level + 1, parent[3], digest([children[k] for k in sorted(children)])
                else:
                    out.append((key, size, level, at, held, True))
            yield batch_of(out)
        yield batch_of([(key, size, level - 1, at * p.arity + k, held, False) for (key, size, level, at), children in partial.items() for k, held in children.items()])

    return trimmed(run)


def _tree(leaves: DataFrame, most: int, p: Merkle) -> list[DataFrame]:
    """Nodes of every ``levels``-th level, and their keys' roots, round by round, over the ``leaves`` (key, size, at, digest).

    ``most`` is the largest size of a key.
    """
    events, found = leaves.withColumn("level", F.lit(0)), []
    columns = ["key", "size", "level", "at", "digest"]
    for r in range(p.rounds(most)):
        goal = (r + 1) * p.levels
        met = cut(events.select(columns).mapInArrow(_climb(goal, p), _NODE))
        block = F.expr(f"at div cast(pow({p.arity}, {goal} - level) as long)")
        rest = met.where("not done").repartition("key", block).select(columns).mapInArrow(_climb(goal, p), _NODE)
        found.append(cut(met.where("done").union(rest).select(columns)))
        forget(met)
        events = found[-1].where((F.col("level") == goal) & (F.col("size") > p.arity**goal))
    return found


def _inner(children: list[str], rise: int, p: Merkle) -> list[list[str]]:
    """Paths of one block's children, all nodes ``rise`` levels below one, up to it."""
    levels = [children]
    while len(levels) <= rise:
        below = levels[-1]
        levels.append([digest(below[k : k + p.arity]) for k in range(0, len(below), p.arity)])
    paths = []
    for k in range(len(children)):
        path, at = [], k
        for nodes in levels[:rise]:
            run = at - at % p.arity
            path += ["".join(nodes[run:at]), "".join(nodes[at + 1 : run + p.arity])]
            at //= p.arity
        paths.append(path)
    return paths


def _down(r: int, p: Merkle, finish):
    """One block's children (key, size, at, digest, ...) and its path to the rows that ``finish`` makes of them and their paths."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        rise = min(p.levels, p.height(rows.column("size")[0].as_py()) - (r - 1) * p.levels)
        upper = above.column("path")[0].as_py()
        inner = _inner(rows.column("digest").to_pylist(), rise, p)
        return finish(rows, [path + upper for path in inner])

    return run


def _further(rows: pa.Table, paths: list[list[str]]) -> pa.Table:
    return rows.select(["key", "at"]).append_column("path", pa.array(paths, pa.list_(pa.string())))


def _paths(leaves: DataFrame, tree: list[DataFrame], roots: DataFrame, finish, schema: str, p: Merkle) -> DataFrame:
    """What ``finish`` makes of the leaves and their paths; ``roots`` has the path of each key's root (key, rounds, path)."""
    above = None
    for r in range(len(tree), 0, -1):
        begun = roots.where(F.col("rounds") == r).select("key", F.lit(0).cast("long").alias("at"), "path")
        above = begun if above is None else begun.union(above)
        rows = leaves if r == 1 else tree[r - 2].where((F.col("level") == (r - 1) * p.levels) & (F.col("size") > p.span ** (r - 1)))
        blocks = rows.withColumn("block", F.expr(f"at div {p.span}L")).groupBy("key", "block")
        of = above.withColumnRenamed("at", "block").groupBy("key", "block")
        above = blocks.cogroup(of).applyInArrow(_down(r, p, finish if r == 1 else _further), schema if r == 1 else "key string, at long, path array<string>")
        if r > 1:
            above = cut(above)
    return above


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (with a non-null ``key``) with at, the number in their key by ``order``, and size, the rows of the key; the largest size.

    Numbers are made over ranges of the order, so a key of any share of all rows takes many tasks; so do equal rows.
    """
    by = ["key", *order, "its_place"]
    ranged = rows.withColumn("its_place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("its_place")
    table = cut(ranged.withColumn("nth", F.monotonically_increasing_id()).withColumn("part", F.shiftright("nth", 33)))
    runs = table.groupBy("key", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    mine = Window.partitionBy("key")
    runs = cut(runs.select("key", "part", (F.sum("n").over(mine.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(mine).alias("size")))
    count, most = runs.agg(F.count("*"), F.max("size")).first()
    return table.join(small(runs, count), ["key", "part"]).withColumn("at", F.col("nth") + F.col("shift")).drop("nth", "part", "shift"), most or 0


def _finished(root: str):
    def run(rows: pa.Table, paths: list[list[str]]) -> pa.Table:
        leaves, claims = rows.column("digest").to_pylist(), rows.column("claim").to_pylist()
        folded = [fold(leaf if claim is None else claim, path) for leaf, claim, path in zip(leaves, claims, paths, strict=True)]
        out = rows.select(["key", "id", "at"]).append_column("leaf", rows.column("digest"))
        out = out.append_column("proof_sha256", pa.array([digest(path) for path in paths], pa.string()))
        out = out.append_column("folded_root", pa.array(folded, pa.string()))
        return out.append_column("verified", pa.array([x == root for x in folded], pa.bool_()))

    return run


def leaf_text(*columns: Column) -> Column:
    """What a leaf digests: for each value ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    items = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.concat(*items)


def proved(leaves: DataFrame, p: Merkle = Merkle()) -> DataFrame:
    """lang, id, at, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf (lang, id, leaf, claim).

    The leaves of a lang ascend by id, nulls first, then by digest; equal rows have places of their own. ``claim`` is a digest
    that stands in for the leaf when the root is recomputed, null for the leaf itself. Subroots ascend by lang, null first. A
    single leaf is its subroot and a single subroot the root. An empty table gives an empty table.
    """
    ship(leaves.sparkSession)
    kind = dict(leaves.dtypes)["id"]
    keyed = leaves.select(F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("key"), "id", F.col("leaf").alias("digest"), "claim")
    placed, most = numbered(keyed, ["id", "digest"])
    tree = _tree(placed.select("key", "size", "at", "digest"), max(most, 1), p)
    # a key's root is the node of a level that has only it
    tops = [level.where("at = 0").where(F.col("size") <= p.span ** (r + 1)).where(F.col("size") > (p.span**r if r else 0)).withColumn("rounds", F.lit(r + 1)) for r, level in enumerate(tree)]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.union(more)
    subroots = cut(subroots.select("key", "digest", "rounds"))
    upper, keys = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("own"), "digest", "rounds"), ["own"])
    crown = _tree(upper.select("key", "size", "at", "digest"), max(keys, 1), p)
    top = crown[-1].where("at = 0").first()
    root = top["digest"] if top else digest([])
    start = leaves.sparkSession.range(1 if top else 0).select(F.lit("").alias("key"), F.lit(len(crown)).alias("rounds"), F.array().cast("array<string>").alias("path"))
    over = cut(_paths(upper, crown, start, lambda rows, paths: rows.select(["own", "rounds", "digest"]).append_column("path", pa.array(paths, pa.list_(pa.string()))), "own string, rounds int, digest string, path array<string>", p))
    roots = over.select(F.col("own").alias("key"), "rounds", "path")
    out = _paths(placed, tree, roots, _finished(root), f"key string, id {kind}, at long, leaf string, proof_sha256 string, folded_root string, verified boolean", p)
    its = over.select(F.col("own").alias("key"), F.col("digest").alias("subroot"))
    lang = F.when(F.col("key") != "", F.expr("substr(key, 2)")).alias("lang")
    return out.join(small(its, keys), "key").select(lang, "id", "at", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")


def manifest(docs: DataFrame, p: Merkle = Merkle()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``, whose other columns are ignored.

    A leaf digests doc_id, source, lang, n_chars and text; each may be null, a text empty or very long. Where 7 divides the crc32 of
    doc_id (never for a null), the recomputed root is that of the row with n_chars one higher; a null n_chars stays, and is verified then.
    Rows of one doc_id are ordered by their leaves, and repeated rows have places of their own. An empty table gives an empty table.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*fields[:3], (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)"), fields[4]]
    tampered = crc_mod("doc_id", 7) == 0
    leaves = docs.select("lang", F.col("doc_id").alias("id"), F.sha2(leaf_text(*fields), 256).alias("leaf"), F.when(tampered, F.sha2(leaf_text(*more), 256)).alias("claim"))
    return proved(leaves, p).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
