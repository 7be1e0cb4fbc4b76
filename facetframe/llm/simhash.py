"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint carries a table: its Hamming distances to many reference fingerprints. By the triangle inequality
two fingerprints within ``bits`` of each other differ by at most ``bits`` in every entry, so pairs with a larger difference are
discarded by their tables alone and only the survivors are held together bit by bit.

A table's entries are no join key (any one of them lets half of all pairs pass), so the pairs that meet are those of
fingerprints with an equal segment: of ``bits`` + 1 segments one at least is equal in a linked pair. Crowded segments are cut
again, over the bits that are left, and what stays crowded is dealt to blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import blocks, lower, trimmed, utf8, words
from ._common import cut, forget, small
from .graph import _forest, components


@dataclass(frozen=True)
class SimHash:
    """``width``: words of a shingle. ``bits``: differing bits that still link. ``pivots``: references of a distance table.

    ``crowd``: fingerprints with one segment value from which the segment is cut again, ``cuts`` times at most; ``side``:
    fingerprints on either side of a block. None of them changes which links are found.
    """

    width: int = 4
    bits: int = 4
    pivots: int = 32
    crowd: int = 4096
    cuts: int = 2
    side: int = 1024
    seed: int = 42


#: Shingles whose bits are counted at once.
_COUNTED = 1 << 16


def fingerprints(column: pa.Array, p: SimHash) -> np.ndarray:
    """The uint64 fingerprint of every text: bits set in over half of its shingles' XXH64, repeats included."""
    data, offsets = utf8(column)
    out = np.zeros(len(column), np.uint64)
    hashed = xxhash.xxh64_intdigest
    for i, j in blocks(offsets):
        base = int(offsets[i])
        part = lower(data[base : int(offsets[j])])
        starts, ends, row = words(part, offsets[i : j + 1] - base)
        if not len(starts):
            continue
        # words of the block with one blank between: a shingle is a slice of it
        size = ends - starts
        to = np.concatenate([[0], np.cumsum(size + 1)])
        kept = np.zeros(int(to[-1]), np.uint8)
        kept[:] = 0x20
        at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        kept[at] = part[np.repeat(starts - to[:-1], size) + at]
        text = kept.tobytes()
        first = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if a == b:
                continue
            k = min(p.width, b - a)
            n = b - a - k + 1
            left, right = to[a : a + n].tolist(), (to[a + k : b + 1] - 1).tolist()
            counts = np.zeros(64, np.int64)
            for lo in range(0, n, _COUNTED):
                h = np.array([hashed(text[x:y], p.seed) for x, y in zip(left[lo : lo + _COUNTED], right[lo : lo + _COUNTED], strict=True)], np.uint64)
                counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i + r] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
    return out


def references(p: SimHash) -> np.ndarray:
    """The reference fingerprints: random, so that each halves the bits anew."""
    return np.random.default_rng(p.seed).integers(0, 1 << 64, p.pivots, np.uint64)


def distances(prints: np.ndarray, p: SimHash) -> np.ndarray:
    """The pivot distance table: a row of ``pivots`` distances for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ references(p)[None, :])


def near(prints: np.ndarray, table: np.ndarray, asks: np.ndarray, p: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of rows within ``bits``, one of which ``asks`` and the other does not; of all rows if all ask.

    Rows are sorted by their first distance, so that a chunk meets a window of it; further distances discard pairs, some at a time,
    and bits are compared of those only that no distance has discarded.
    """
    order = np.argsort(table[:, 0], kind="stable")
    t = table[order].astype(np.int16)
    x, asking, every = prints[order], asks[order], bool(asks.all())
    found_a, found_b = [], []
    for lo in range(0, len(x), 256):
        hi = min(lo + 256, len(x))
        end = int(np.searchsorted(t[:, 0], t[hi - 1, 0] + p.bits, "right"))
        a, b = np.arange(lo, hi)[:, None], np.arange(lo, end)[None, :]
        alive = (b > a) & (every | (asking[a] ^ asking[b]))
        for k in range(min(4, p.pivots)):
            alive &= np.abs(t[lo:hi, k][:, None] - t[lo:end, k][None, :]) <= p.bits
        i, j = np.nonzero(alive)
        i, j = i + lo, j + lo
        for k in range(4, p.pivots, 7):
            keep = (np.abs(t[i, k : k + 7] - t[j, k : k + 7]) <= p.bits).all(axis=1)
            i, j = i[keep], j[keep]
        close = np.bitwise_count(x[i] ^ x[j]) <= p.bits
        found_a.append(order[i[close]])
        found_b.append(order[j[close]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _printed(p: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("text"), p).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])

    return trimmed(run)


def _tabled(p: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = distances(batch.column("print").to_numpy().view(np.uint64), p)
            flat = pa.py_buffer(np.ascontiguousarray(table).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("print"), pa.Array.from_buffers(pa.binary(p.pivots), len(table), [None, flat]).cast(pa.binary())], names=["print", "distances"])

    return trimmed(run)


def _held(p: SimHash):
    """One block's links, thinned to the stars of its components: what they connect is all that counts."""

    def run(block: pa.Table) -> pa.Table:
        prints = block.column("print").to_numpy()
        table = np.frombuffer(b"".join(block.column("distances").to_pylist()), np.uint8).reshape(-1, p.pivots)
        a, b = near(prints.view(np.uint64), table, np.array(block.column("asks").to_pylist(), bool), p)
        a, b = _forest(prints[a], prints[b]) if len(a) else (prints[:0], prints[:0])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _segments(free: list[int], parts: int) -> list[list[int]]:
    """The bits ``free`` dealt in turn to ``parts`` segments."""
    return [free[k::parts] for k in range(parts)]


def _value(bits: list[int]) -> F.Column:
    mask = sum(1 << b for b in bits)
    return F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _met(tabled: DataFrame, p: SimHash) -> DataFrame:
    """(print, distances, bucket) of the fingerprints that share a bucket with others: a segment's value, or those of nested segments.

    A linked pair shares one bucket at least: its differing bits leave one segment untouched in each cut.
    """

    def shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with the size of their bucket, not crowded and crowded ones; rows that are alone are left out."""
        sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        rows = rows.join(small(sizes, sizes.count()), "bucket")
        return rows.where(F.col("n") <= p.crowd), rows.where(F.col("n") > p.crowd)

    ways = [(k, bits) for k, bits in enumerate(_segments(list(range(64)), p.bits + 1))]
    rows = tabled.select("print", "distances", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.xxhash64(F.lit(k), _value(bits)).alias("bucket")) for k, bits in ways])).alias("at")).select("print", "distances", "at.*")
    done, crowded = shared(rows)
    out = done
    names = {k: bits for k, bits in ways}
    for _ in range(p.cuts):
        crowded = cut(crowded.drop("n"))
        if crowded.isEmpty():
            forget(crowded)
            return out
        deeper, cases = {}, []
        for way, used in names.items():
            for bits in _segments([b for b in range(64) if b not in used], p.bits + 1):
                deeper[k := len(deeper)] = used + bits
                cases.append((way, F.struct(F.lit(k).alias("way"), F.xxhash64("bucket", F.lit(k), _value(bits)).alias("bucket"))))
        step = None
        for way in names:
            ends = F.array(*[c for w, c in cases if w == way])
            step = F.when(F.col("way") == way, ends) if step is None else step.when(F.col("way") == way, ends)
        done, crowded = shared(crowded.select("print", "distances", F.explode(step).alias("at")).select("print", "distances", "at.*"))
        out, names = out.unionByName(done), deeper
    return out.unionByName(crowded)


def linked(prints: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """Links (a, b) that connect what the links of all ``prints`` (distinct, signed longs) connect."""
    tabled = cut(prints.mapInArrow(_tabled(p), "print long, distances binary"))
    met = cut(_met(tabled, p).select("print", "distances", "bucket", "n"))
    # blocks of a bucket: a row asks in its own part against every part up to it
    parts = F.ceil(F.col("n") / p.side)
    own = met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("print", F.lit(1)), F.col("parts")))
    other = F.explode(F.expr("sequence(0L, parts - 1)"))
    dealt = own.withColumn("other", other).select("print", "distances", "bucket", F.greatest("own", "other").alias("hi"), F.least("own", "other").alias("lo"), (F.col("own") >= F.col("other")).alias("asks"))
    links = cut(dealt.groupBy("bucket", "hi", "lo").applyInArrow(_held(p), "a long, b long"))
    forget(tabled, met)
    return links


def near_duplicates(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows whose fingerprints differ in ``bits`` bits at most are linked; component_id is the smallest doc_id that links reach,
    null if they reach none. Equal fingerprints are one node. A text of fewer than ``width`` words is one shingle; a null or
    empty text, or one without words, has the fingerprint zero and is linked like any other. Repeated rows, and rows of one
    doc_id, are linked by their fingerprints alone. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    printed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_printed(p), "doc_id long, print long"))
    prints = cut(printed.groupBy("print").agg(F.min("doc_id").alias("least")))
    labels = components(linked(prints.select("print"), p))
    n = labels.count()
    named = cut(prints.join(small(labels.select(F.col("node").alias("print"), "component"), n), "print", "left").select("print", "least", F.coalesce("component", "print").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = cut(named.join(small(cut(least), n), "component", "left").select("print", F.coalesce("component_id", "least").alias("component_id")))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return printed.join(small(told, prints.count()), "print").select("doc_id", digits.alias("fingerprint"), "component_id")
