"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a window of words: the hash takes the words at its ones, so words at its zeros may have been
replaced. Windows of documents and benchmark items that meet under a seed are aligned, and the aligned words are compared
around the hit.

The seeds miss no overlap. In a best stretch every prefix has more gain than loss, so with a penalty of 2 the first
mismatch is its fourth word at the earliest and the second its seventh. The masks are all ways to put two zeros so
into the first eight words: one of them fits the start of every stretch of 12 equal words or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ._bytes import blocks, hashes, mix, plain, trimmed, utf8, words
from ._common import cut, without


@dataclass(frozen=True)
class SpacedSeeds:
    """``masks``: of equal span. ``least``: equal words that an overlap needs, or all words of a shorter item;
    ``penalty``: what a replaced word costs in equal words while an overlap is extended, so about a third of the words may
    differ (the masks are complete for 2 and more). ``broadcast_bytes``: benchmark text up to which its seeds are
    broadcast (16 bytes a word and mask); beyond it the windows are joined by a shuffle.
    """

    masks: tuple[str, ...] = ("11101101", "11110101", "11111001", "11101110", "11110110", "11111010", "11111100")
    least: int = 12
    penalty: int = 2
    broadcast_bytes: int = 16_000_000

    @property
    def span(self) -> int:
        return len(self.masks[0])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, which are runs of bytes other than ASCII white space and punctuation, and their rows."""
    part = plain(data)
    starts, ends, row = words(part, offsets)
    return hashes(part, starts, ends), row


def _seeded(h: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For each mask the hash of every window of ``h``."""
    span = max(map(len, masks), default=0)
    each = [h[k:] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3)) % (1 << 64) | 1) for k in range(min(span, len(h)))]
    whole: dict[int, np.ndarray] = {}  # sums over all words of a window, by its span
    out = []
    for mask in masks:
        n = len(h) - len(mask) + 1
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        if len(mask) not in whole:
            whole[len(mask)] = np.add.reduce([x[:n] for x in each[: len(mask)]])
        total = whole[len(mask)] + np.uint64(int(mask, 2) * 0x51ED270B)
        for k, bit in enumerate(mask):
            if bit == "0":
                total -= each[k][:n]
        out.append(mix(total))
    return out


def _whole(length: int) -> str:
    """The mask of an item that is shorter than the span: all its words."""
    return "1" * length


def _overlap(a: np.ndarray, b: np.ndarray, shift: int, penalty: int) -> int:
    """Most equal words in a stretch of ``a`` against ``b`` moved by ``shift`` (position in a minus position in b)."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    gain = np.where(a[lo:hi] == b[lo - shift : hi - shift], 1, -penalty)
    sums = np.concatenate([[0], np.cumsum(gain)])
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return int((gain[start:end] > 0).sum())


#: In place of the shift of an item that is found whole.
_ANYWHERE = np.iinfo(np.int64).min


class _Index:
    """Seed hashes of the benchmark, sorted, with the items and positions they come from."""

    def __init__(self, ids: list[int], texts: pa.Array, p: SpacedSeeds) -> None:
        data, offsets = utf8(texts)
        h, row = _tokens(data, offsets)
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        self.ids, self.items = ids, [h[at[k] : at[k + 1]] for k in range(len(ids))]
        self.short = sorted({len(x) for x in self.items if 0 < len(x) < p.span})
        keys, item, place = [], [], []
        for k, own in enumerate(self.items):
            for seeds in _seeded(own, p.masks if len(own) >= p.span else (_whole(len(own)),)) if len(own) else []:
                keys.append(seeds)
                item.append(np.full(len(seeds), k, np.int32))
                place.append(np.arange(len(seeds), dtype=np.int32))
        keys, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (item, np.int32), (place, np.int32)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.bits = max(20, len(keys).bit_length() + 2)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window positions and index entries that meet."""
        maybe = np.flatnonzero(self.seen[(seeds >> np.uint64(64 - self.bits)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.keys, seeds[maybe], side) for side in ("left", "right"))
        n = hi - lo
        return np.repeat(maybe, n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _found(batch: pa.RecordBatch, index: _Index, p: SpacedSeeds) -> tuple[list[dict[int | None, int]], list[int]]:
    """For each row the equal words of the items it overlaps, and the most of them."""
    items: list[dict[int | None, int]] = [{} for _ in range(batch.num_rows)]
    data, offsets = utf8(batch.column("text"))
    for i, j in blocks(offsets):
        base = offsets[i]
        h, row = _tokens(data[base : offsets[j]], offsets[i : j + 1] - base)
        first = np.searchsorted(row, np.arange(j - i + 1))
        met, masks = [], (*p.masks, *map(_whole, index.short))
        for mask, seeds in zip(masks, _seeded(h, masks), strict=True):
            at, entry = index.hits(seeds)
            inside = row[at] == row[at + len(mask) - 1]
            at, entry = at[inside], entry[inside]
            # where a short item lies does not matter, so it is looked at once a row
            shift = at - first[row[at]] - index.place[entry] if len(mask) == p.span else np.full(len(at), _ANYWHERE)
            met.append(np.stack([row[at], index.item[entry], shift], axis=1))
        for r, item, shift in np.unique(np.concatenate(met), axis=0) if met else []:
            other = index.items[item]
            equal = len(other) if shift == _ANYWHERE else _overlap(h[first[r] : first[r + 1]], other, int(shift), p.penalty)
            if equal >= min(p.least, len(other)):
                own = items[i + r]
                own[index.ids[item]] = max(equal, own.get(index.ids[item], 0))
    return items, [max(x.values(), default=0) for x in items]


def _scanned(index, p: SpacedSeeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, most = _found(batch, index.value, p)
            columns = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            items = [sorted(k for k in x if k is not None) for x in items]
            yield pa.RecordBatch.from_arrays([*(c for _, c in columns), pa.array(items, pa.list_(pa.int64())), pa.array(most, pa.int64())], names=[*(n for n, _ in columns), "items", "most_equal"])

    return trimmed(run)


def _windows(p: SpacedSeeds, short: list[int] | None = None):
    """(id, seed hash, position, span) of every window of a table (id, text).

    Of documents also the windows of ``short`` words; without ``short`` the rows are items, and those below the span are one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                h, row = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                first = np.searchsorted(row, np.arange(j - i + 1))
                words_in = np.diff(first)
                lengths = short if short is not None else sorted({int(n) for n in words_in if 0 < n < p.span})
                masks = (*p.masks, *map(_whole, lengths))
                for mask, seeds in zip(masks, _seeded(h, masks), strict=True):
                    at = np.flatnonzero(row[: len(seeds)] == row[len(mask) - 1 :]) if len(seeds) else np.zeros(0, np.int64)
                    if short is None and len(mask) < p.span:
                        at = at[words_in[row[at]] == len(mask)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + row[at]]), pa.array(seeds[at].view(np.int64)), pa.array(at - first[row[at]]), pa.array(np.full(len(at), len(mask)))], names=["id", "seed", "place", "span"])

    return trimmed(run)


def _verified(p: SpacedSeeds):
    """Aligned pairs (doc_key, item_id, shift, text, item_text) to (doc_key, item_id, equal, needed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                sides = []
                for name in ("text", "item_text"):
                    data, offsets = utf8(batch.column(name))
                    h, row = _tokens(data, offsets)
                    at = np.searchsorted(row, np.arange(batch.num_rows + 1))
                    sides.append([h[at[k] : at[k + 1]] for k in range(batch.num_rows)])
                equal = pa.array([_overlap(a, b, s, p.penalty) for a, b, s in zip(*sides, batch.column("shift").to_pylist(), strict=True)], pa.int64())
                needed = pa.array([min(p.least, len(b)) for b in sides[1]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("item_id"), equal, needed], names=["doc_key", "item_id", "equal", "needed"])

    return trimmed(run)


def _joined(docs: DataFrame, bench: DataFrame, keep: list[str], p: SpacedSeeds) -> DataFrame:
    """The same by joins, for a benchmark beyond any bound."""
    keyed = cut(docs.withColumn("doc_key", F.monotonically_increasing_id()))
    windows = "id long, seed long, place long, span long"
    keys = cut(bench.withColumn("item_key", F.monotonically_increasing_id()))
    right = cut(keys.select("item_key", "text").mapInArrow(_windows(p), windows))
    short = sorted(r["span"] for r in right.where(F.col("span") < p.span).select("span").distinct().collect())
    left = keyed.select("doc_key", "text").mapInArrow(_windows(p, short), windows)
    hits = left.join(right.select(F.col("id").alias("item_key"), "seed", F.col("place").alias("item_place"), "span"), ["seed", "span"])
    # where a short item lies does not matter, so it is one hit a document
    hits = cut(hits.select(F.col("id").alias("doc_key"), "item_key", F.when(F.col("span") == p.span, F.col("place") - F.col("item_place")).alias("shift"), "span").distinct())
    pairs = hits.where("shift is not null").join(keyed.select("doc_key", "text"), "doc_key").join(keys.select("item_key", "item_id", F.col("text").alias("item_text")), "item_key")
    found = pairs.select("doc_key", "item_id", "shift", "text", "item_text").mapInArrow(_verified(p), "doc_key long, item_id long, equal long, needed long").where("equal >= needed")
    found = found.select("doc_key", "item_id", "equal").union(hits.where("shift is null").join(keys, "item_key").select("doc_key", "item_id", "span"))
    by = found.groupBy("doc_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("equal").alias("most_equal"))
    return keyed.select("doc_key", *keep).join(by, "doc_key", "left").select(*keep, F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.coalesce("most_equal", F.lit(0).cast("long")).alias("most_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame, p: SpacedSeeds = SpacedSeeds(), keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id) of every row of ``docs``, with items (ids of the benchmark items that its text overlaps,
    ascending), most_equal (most equal words of an overlap, 0 for none) and contaminated.

    ``benchmark`` has item_id and text; other columns are ignored on both sides. Null texts are empty. An item of
    fewer than ``least`` words is overlapped where all its words follow each other; texts and items without words overlap
    nothing, as do all if either table is empty. Repeated rows and items each count for themselves. An item of a null item_id
    contaminates like others and is not in ``items``.
    """
    spark = ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select(*keep, "text")
    size = bench.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    if size <= p.broadcast_bytes:
        got = bench.orderBy("item_id", "text").toArrow()
        texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
        index = spark.sparkContext.broadcast(_Index(got.column("item_id").to_pylist(), texts, p))
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField("items", T.ArrayType(T.LongType())), T.StructField("most_equal", T.LongType())])
        found = rows.mapInArrow(_scanned(index, p), schema)
    else:
        found = _joined(rows, bench, keep, p)
    return found.withColumn("contaminated", F.col("most_equal") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, p: SpacedSeeds = SpacedSeeds()) -> DataFrame:
    """Rows of ``docs`` that overlap no benchmark item; all columns as they are."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return without(docs, overlaps(rows, benchmark, p, keep=["doc_id", "text_hash"]).where("contaminated"))
