"""Circulant MinHash near-duplicate groups: candidates from banded signatures, links confirmed on whole sets.

One permutation scatters a document's shingles over a universe of 2^20 coordinates; coordinate k of the signature is
the smallest value that a second permutation, circularly shifted by k, gives to them. So a shingle's values under all
shifts are one contiguous slice of the second permutation, and a signature is the minimum over slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import mix, shingle_sets, trimmed
from ._common import counted, cut, forget, rows_of, settings, small
from .graph import components, composed


@dataclass(frozen=True)
class NearDuplicates:
    """``threshold`` percent of Jaccard similarity links two documents.

    32 bands of 4 rows miss a pair of similarity 0.75 once in 190,000 (0.684^32); ``floor`` of 128 equal coordinates
    before the exact check is five standard deviations below the 96 expected there. Both only choose candidates.
    Rounds of one pivot for each bucket go on, ``rounds`` at most, while they link ``yield_`` of what they check; then
    blocks of ``asking`` members are held against blocks of ``asked`` for all pairs of a bucket still unconnected. Where whole
    texts are held, a block has ``held`` shingles on either side, about.
    """

    width: int = 5
    threshold: int = 75
    bands: int = 32
    rows: int = 4
    universe_bits: int = 20
    floor: int = 70
    rounds: int = 8
    yield_: float = 0.05
    asking: int = 64
    asked: int = 512
    held: int = 1_000_000
    seed: int = 20

    @property
    def size(self) -> int:
        return self.bands * self.rows


_slices: dict[tuple, np.ndarray] = {}


def _shifted(p: NearDuplicates) -> np.ndarray:
    """Row x: what the second permutation, shifted by 0, 1, ..., gives to coordinate x."""
    key = (p.size, p.universe_bits, p.seed)
    if key not in _slices:
        n = 1 << p.universe_bits
        second = np.random.default_rng(p.seed).permutation(n).astype(np.int32)
        _slices[key] = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: p.size]]), p.size)
    return _slices[key]


def signature(shingles: np.ndarray, p: NearDuplicates) -> np.ndarray:
    """All signature coordinates of a non-empty set of 64-bit shingle hashes."""
    mask = np.uint64((1 << p.universe_bits) - 1)
    first = (((shingles >> np.uint64(40)) & mask) * np.uint64(2654435761) + np.uint64(97)) & mask
    rows = _shifted(p)
    out = np.full(p.size, 1 << p.universe_bits, np.int32)
    for i in range(0, len(first), 4096):
        np.minimum(out, rows[first[i : i + 4096]].min(axis=0), out=out)
    return out


_SIGNED = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def _signed(p: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, p.bands + 1, dtype=np.uint64))
        odd = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            n, keys, signatures = [], [], []
            for _, s in shingle_sets(batch.column("text"), p.width):
                n.append(len(s))
                if len(s):
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    signatures.append(signature(s, p))
                else:
                    keys.append(None)
                    signatures.append(None)
            have = [x for x in signatures if x is not None]
            matrix = np.stack(have) if have else np.zeros((0, p.size), np.int32)
            h = np.broadcast_to(salt, (len(have), p.bands)).copy()
            for r in range(p.rows):
                h = mix(h * odd + matrix[:, r * p.bands : (r + 1) * p.bands].astype(np.uint64))
            at = iter(range(len(have)))
            rows = [None if x is None else next(at) for x in signatures]
            low = matrix.astype(np.uint8)
            signed = h.view(np.int64)
            columns = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([None if k is None else signed[k] for k in rows], pa.list_(pa.int64())), pa.array([None if k is None else low[k].tobytes() for k in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "sketch"])

    return trimmed(run)


def _alike(p: NearDuplicates):
    """Keeps pairs whose sketches agree in ``floor`` coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, p.size) for k in ("sketch_a", "sketch_b"))
            same = pa.array((a == b).sum(axis=1) >= p.floor)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(same) for k in ("a", "b", "comp_a", "comp_b")], names=["a", "b", "comp_a", "comp_b"])

    return trimmed(run)


def _linked(p: NearDuplicates):
    """Exact check on the whole shingle sets: the pairs and whether they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):  # two texts a row: only a few sets are held at once
                batch = whole.slice(i, 64)
                ids = batch.column("a").to_pylist()
                fresh = [k for k, x in enumerate(ids) if not k or x != ids[k - 1]]
                left = dict(zip(fresh, (s for _, s in shingle_sets(batch.column("text_a").take(pa.array(fresh)), p.width)), strict=True))
                linked, a = [], None
                for k, b in shingle_sets(batch.column("text_b"), p.width):
                    a = left.get(k, a)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked.append(100 * both >= p.threshold * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "comp_a", "comp_b")), pa.array(linked)], names=["a", "b", "comp_a", "comp_b", "linked"])

    return trimmed(run)


def _pairs_in(p: NearDuplicates, whole: bool):
    """In one block of a bucket, holds the asking rows against all rows of other components.

    On sketches (``whole`` false) it returns the rows that agree with any; on texts the components of linked pairs.
    """

    def run(block: pa.Table) -> pa.Table:
        asks = np.array(block.column("asks").to_pylist(), bool)
        comp = block.column("comp").to_numpy()
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        if whole:
            pairs: set[tuple[int, int]] = set()
            sets = [s for _, s in shingle_sets(block.column("text").combine_chunks() if block.num_rows else block.column("text"), p.width)]
            known = np.unique(np.concatenate([sets[k] for k in q])) if len(q) else np.zeros(0, np.uint64)
            holds = np.zeros((len(known) + 1, len(q)), np.uint8)
            for k, x in enumerate(q):
                holds[np.searchsorted(known, sets[x]), k] = 1
            sizes = np.array([len(sets[x]) for x in q], np.int64)
            for x in d if len(q) else []:
                at = np.searchsorted(known, sets[x])
                at = at[known[np.minimum(at, len(known) - 1)] == sets[x]]
                both = holds[at].sum(axis=0, dtype=np.int64)
                for k in np.flatnonzero((100 * both >= p.threshold * (sizes + len(sets[x]) - both)) & (comp[q] != comp[x])):
                    pairs.add((int(min(comp[q[k]], comp[x])), int(max(comp[q[k]], comp[x]))))
            return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})
        sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(-1, p.size)
        met = np.zeros(block.num_rows, bool)
        for x in q:
            hit = d[((sketch[d] == sketch[x]).sum(axis=1) >= p.floor) & (comp[d] != comp[x])]
            met[hit] = True
            met[x] |= len(hit) > 0
        return pa.table({"bucket": block.column("bucket").filter(pa.array(met)), "node": block.column("node").filter(pa.array(met))})

    return run


def _grid(found: DataFrame, p: NearDuplicates) -> DataFrame:
    """Rows of the blocks that together hold all pairs of unlike components of each bucket (bucket, node, comp, weight).

    Of such a pair one at least is outside the bucket's largest component: those ask, all are asked. The rows are
    dealt to blocks by a hash, so that a block has so many rows, and so much weight, on either side.
    """
    parts = found.groupBy("bucket", "comp").agg(F.count("*").alias("part"), F.sum("weight").alias("load"))
    main = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("part", F.col("comp"))).alias("main"), F.sum("part").alias("n"), (F.sum("part") - F.max("part")).alias("rest"), F.sum("load").alias("load")).where("rest > 0")
    main = main.select("bucket", "main", F.ceil(F.greatest(F.col("rest") / p.asking, F.col("load") / p.held)).alias("asking"), F.ceil(F.greatest(F.col("n") / p.asked, F.col("load") / p.held)).alias("asked"))
    main = counted(main)
    rows = found.join(small(main), "bucket").drop("weight")
    ask = rows.where("comp <> main").withColumns({"block": F.expr("pmod(xxhash64(node, 1), asking)"), "part": F.explode(F.expr("sequence(0L, asked - 1)")), "asks": F.lit(True)})
    all_ = rows.withColumns({"part": F.expr("pmod(xxhash64(node, 2), asked)"), "block": F.explode(F.expr("sequence(0L, asking - 1)")), "asks": F.lit(False)})
    columns = ["bucket", "block", "part", "node", "comp", "asks"]
    return ask.select(columns).union(all_.select(columns))


def _merged(found: DataFrame) -> DataFrame:
    """``found`` with the buckets that share members made one, where that takes fewer comparisons than one by one.

    Near copies meet in many buckets; there each pair would be held together as often. Buckets that only
    some chance members connect stay apart.
    """

    def cost(keys: list[str]) -> DataFrame:
        parts = found_in.groupBy(*keys, "comp").agg(F.count_distinct("node").alias("part"))
        return parts.groupBy(*keys).agg((F.sum("part") * (F.sum("part") - F.max("part"))).alias("cost"))

    first = counted(found.groupBy("bucket").agg(F.min("node").alias("a")))
    cluster = components(found.join(small(first), "bucket").select("a", F.col("node").alias("b")))
    found_in = cut(found.join(small(cluster).select("node", F.col("component").alias("cluster")), "node"))
    apart = cost(["cluster", "bucket"]).groupBy("cluster").agg(F.sum("cost").alias("apart"))
    one = counted(cost(["cluster"]).join(apart, "cluster").select("cluster", (F.col("cost") <= F.col("apart")).alias("one")))
    key = F.when(F.col("one"), F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.col("bucket"))
    return cut(found_in.join(small(one), "cluster").select(key.alias("bucket"), "node", "comp").distinct())


def _texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(node, text) of the ``nodes``, ``most`` of them at most, from the first row of each set."""
    wanted = sets.select("node", F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash")).join(small(nodes, most), "node", "left_semi")
    same = docs["doc_id"].eqNullSafe(F.col("its_id")) & (F.xxhash64(docs["text"]) == F.col("its_hash"))
    return docs.join(small(wanted, most), same).groupBy("node").agg(F.min("text").alias("text"))


def _rest(found: DataFrame, sets: DataFrame, docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """Links (a, b) between unlike components, from all pairs of a bucket that are in such."""
    block = ["bucket", "block", "part"]
    found = _merged(found)
    near = _grid(found.withColumn("weight", F.lit(0)), p).join(sets.select("node", "sketch"), "node").groupBy(*block).applyInArrow(_pairs_in(p, whole=False), "bucket long, node long")
    near = counted(near.distinct())
    ids = counted(near.select("node").distinct())
    n = rows_of(ids)
    left = counted(found.join(small(near), ["bucket", "node"], "left_semi").join(sets.select("node", F.col("n_shingles").alias("weight")).join(small(ids, n), "node", "left_semi"), "node"))
    held = _grid(left, p).join(_texts(docs, sets, ids, n), "node")
    return counted(held.groupBy(*block).applyInArrow(_pairs_in(p, whole=True), "a long, b long").distinct())


def _checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """(a, b, comp_a, comp_b, linked) of the distinct ``pairs``; pairs that their sketches rule out are dropped."""
    spark = docs.sparkSession
    columns = "a long, b long, comp_a long, comp_b long"
    sketches = sets.select("node", "sketch", "n_shingles")
    of = lambda x: sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(f"100 * least(n_a, n_b) >= {p.threshold} * greatest(n_a, n_b)")
    near = counted(sized.select("a", "b", "comp_a", "comp_b", "sketch_a", "sketch_b").mapInArrow(_alike(p), columns))
    ids = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(docs, sets, ids, 2 * rows_of(near))
    both = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="256"):  # rows hold two whole texts
        return cut(both.select("a", "b", "comp_a", "comp_b", "text_a", "text_b").mapInArrow(_linked(p), f"{columns}, linked boolean"))


def _crowded(sets: DataFrame) -> DataFrame:
    """(bucket, node) of all buckets of two or more."""
    rows = sets.select("node", F.explode("bands").alias("bucket"))
    shared = counted(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    return cut(rows.join(small(shared), "bucket").select("bucket", "node"))


def _asked_pairs(asks: DataFrame, pivot: DataFrame) -> DataFrame:
    """Distinct pairs of the rows ``asks`` (bucket, node, comp) and their bucket's ``pivot`` (bucket, pivot, its)."""
    ends = asks.join(small(pivot), "bucket").where("node <> pivot and comp <> its").select(F.struct("node", "comp").alias("x"), F.struct(F.col("pivot").alias("node"), F.col("its").alias("comp")).alias("y"))
    return ends.select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("g")).selectExpr("l.node as a", "g.node as b", "l.comp as comp_a", "g.comp as comp_b").distinct()


def _labels(sets: DataFrame, docs: DataFrame, p: NearDuplicates) -> DataFrame | None:
    """(node, component) of the sets that links connect."""
    buckets = _crowded(sets)
    first = counted(buckets.groupBy("bucket").agg(F.min("node").alias("pivot")).withColumn("its", F.col("pivot")))
    new = _checked(_asked_pairs(buckets.withColumn("comp", F.col("node")), first), sets, docs, p)
    maps, tested = [components(new.where("linked"), "comp_a", "comp_b")], new.select("a", "b")
    told = cut(buckets.join(small(maps[0]), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp")))
    forget(buckets)
    # the pair of a bucket of two has been checked, and one component has nothing left to connect
    parts = told.groupBy("bucket", "comp").agg(F.count("*").alias("part"))
    main = counted(parts.groupBy("bucket").agg(F.max_by("comp", F.struct("part", F.col("comp"))).alias("main"), F.sum("part").alias("n"), F.max("part").alias("most")).where("n > 2 and most < n").select("bucket", "main"))
    open_ = cut(told.join(small(main), "bucket"))
    forget(told)
    asks = open_.where("comp <> main")
    for k in range(1, p.rounds):
        checked, linked = new.agg(F.count("*"), F.count_if("linked")).first()
        if linked <= p.yield_ * checked:
            break
        # the members outside a bucket's largest component are held against one that is in it
        pivot = open_.where("comp = main").groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", F.lit(k))).alias("pivot"))
        pivot = counted(asks.groupBy("bucket").agg(F.first("main").alias("its")).join(pivot, "bucket"))
        new = _checked(_asked_pairs(asks, pivot).join(tested, ["a", "b"], "left_anti"), sets, docs, p)
        tested = tested.union(new.select("a", "b"))
        step = components(new.where("linked"), "comp_a", "comp_b")
        if not rows_of(step):
            continue
        maps.append(step)
        n = rows_of(step)
        for end in ("comp", "main"):
            asks = asks.join(small(step.select(F.col("node").alias(end), "component"), n), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        asks = counted(asks.where("comp <> main"))
    if rows_of(asks):
        left = counted(asks.select("bucket").distinct())
        still = open_.join(small(left), "bucket", "left_semi")
        if len(maps) > 1:
            later = counted(composed(maps[1:]))
            still = still.join(small(later.select(F.col("node").alias("comp"), "component"), rows_of(later)), "comp", "left").withColumn("comp", F.coalesce("component", "comp"))
        more = _rest(cut(still.select("bucket", "node", "comp")), sets, docs, p)
        if rows_of(more):
            maps.append(components(more))
    return composed(maps)


def grouped(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """doc_id, text_hash, n_shingles, group and component_id of every row of ``docs`` (doc_id, text).

    ``group`` is null for rows that nothing is grouped with: those of no words and no doc_id. Rows of one doc_id are
    one document, whatever their texts are: they are in one group.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_signed(p), _SIGNED)
    signed = cut(rows)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    own = F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sketch"), order).alias("own")
    sets = cut(signed.where("set_key is not null").groupBy("set_key").agg(own).select(F.monotonically_increasing_id().alias("node"), "set_key", "own.*"))
    labels = counted(_labels(sets, docs, p))
    node_of = sets.select("node", "set_key", F.col("doc_id").alias("least")).join(small(labels), "node", "left").select("set_key", F.coalesce("component", "node").alias("group"))
    told = cut(signed.select("doc_id", "text_hash", "n_shingles", "set_key").join(node_of, "set_key", "left").drop("set_key"))
    # rows of one doc_id with unlike sets unite the groups of those
    split = told.where("doc_id is not null and group is not null").groupBy("doc_id").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    again = counted(told.where("group is not null").join(split, "doc_id").select(F.col("low").alias("a"), F.col("group").alias("b")).distinct())
    if rows_of(again):
        united = components(again)
        told = told.join(small(united), told["group"] == united["node"], "left").withColumn("group", F.coalesce("component", "group")).drop("node", "component")
    least = counted(told.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    return told.join(small(least), "group", "left").select("doc_id", "text_hash", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents with 100 * |A ∩ B| >= ``threshold`` * |A ∪ B| of their word shingles are linked; component_id is the
    smallest doc_id that links reach. A text of fewer words than ``width`` is one shingle. Null and empty texts and
    texts without words have the empty set, are linked with nothing and are kept. Equal sets are one node from the start.
    Rows that repeat a doc_id are one document: their links, and n_shingles, are those of each text. A row
    of a null doc_id is a document of its own; component_id is null if no link reaches a doc_id, and it is kept then.
    An empty table gives an empty table.

    A round's work on a bucket of n documents is linear: it holds the members against one pivot. Only the members that
    stay outside the bucket's largest component are then held against all others, first by their sketches.
    """
    return grouped(docs, p).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, that of the smallest doc_id, first by its text; all columns as they are.

    Repeated rows and rows of one doc_id are one document. Rows without words and without doc_id all stay.
    """
    rows = cut(grouped(docs, p))
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    chosen = rows.where("group is not null").groupBy("group").agg(F.min(key).alias("key"), F.count("*").alias("rows")).where("rows > 1").select("group", "key")
    chosen = counted(chosen)
    told = rows.join(small(chosen), "group").withColumn("stays", F.col("key") == key)
    told = told.union(rows.where("group is null and doc_id is not null").withColumns({"key": key, "stays": F.lit(True)}).select(told.columns))
    keys = counted(told.groupBy(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash")).agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays"))
    keys = small(keys)
    same = docs["doc_id"].cast("long").eqNullSafe(keys["its_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["its_hash"])
    once = docs.join(keys, same, "left_anti")
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    twice = packed.join(keys.where("stays"), packed["doc_id"].cast("long").eqNullSafe(keys["its_id"]) & F.xxhash64(packed["text"]).eqNullSafe(keys["its_hash"]))
    one = twice.withColumn("nth", F.row_number().over(Window.partitionBy("its_id", "its_hash").orderBy(F.xxhash64("row")))).where("nth = 1")
    return once.union(one.select("row.*").select(*[F.col(f"`{c}`") for c in docs.columns]))
