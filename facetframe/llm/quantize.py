"""Product-quantised vector codes by heap Lloyd.

Vectors travel in blocks, and each block keeps a heap for every entry of every part's codebook: its parts, keyed by their slack, the
lower bound of the distance to all other entries minus the upper bound of that to their own. An entry's cumulative drift
tells how much of their slack its parts may have lost since; only those at the top of the heap whose slack is used up are popped
and rescanned, on whole numbers. Blocks pass on how much the entries' sums and counts have changed, and nothing else.

A heap is an ascending array here: popping takes a prefix of it, and what is pushed is merged in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import trimmed
from ._common import cut, forget, small


@dataclass(frozen=True)
class Quantizer:
    """``parts`` of a vector, ``entries`` of a part's codebook, ``rounds`` of updates, components times ``scale`` as whole numbers, ``block`` vectors at most to a block."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    block: int = 4096


#: Beyond the rounding of a square root of any distance here; a part this near to its bound is rescanned.
_MARGIN = 1e-3


@dataclass
class Codebooks:
    """``entries`` [part, entry, position]; ``drift`` [part, entry]: what the slack of the parts there may have lost since round 0."""

    entries: np.ndarray
    drift: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.drift is None:
            self.drift = np.zeros(self.entries.shape[:2])

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries as means rounded down, and their drift: how far each has moved and the farthest of the others has."""
        used = counts > 0
        new = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], self.entries)
        step = np.sqrt(((new - self.entries) ** 2).sum(axis=2).astype(float))
        drift = self.drift + step
        for j, row in enumerate(step):
            for e in range(len(row)):
                drift[j, e] += np.delete(row, e).max(initial=0.0)
        return Codebooks(new, drift)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to all ``entries``."""
    out = np.empty((len(x), len(entries)), np.int64)
    step = max(1, (1 << 20) // max(1, entries.size))
    for k in range(0, len(x), step):
        out[k : k + step] = ((x[k : k + step, None, :] - entries[None]) ** 2).sum(axis=2)
    return out


def assign(x: np.ndarray, books: Codebooks, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray, int]:
    """One assignment of a block's vectors (whole numbers, a row each).

    ``state``: codes and keys of [part, vector] and the heaps, vectors of a part by code and key; None before the first. Returns
    the new state, the changes of sums [part, entry, position] and counts, and how many parts were rescanned.
    """
    parts, entries, width = books.entries.shape
    sums, counts, rescanned = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
    m = len(x)
    codes, keys, heaps = (s.copy() for s in state) if state else (np.zeros((parts, m), np.uint8), np.zeros((parts, m), np.float32), np.zeros((parts, m), np.int32))
    for j in range(parts):
        if state:
            edge = np.searchsorted(codes[j][heaps[j]], np.arange(entries + 1))
            runs = [heaps[j][edge[e] : edge[e + 1]] for e in range(entries)]
            upto = [int(np.searchsorted(keys[j][run], books.drift[j, e] + _MARGIN, "right")) for e, run in enumerate(runs)]
            popped, rest = np.concatenate([run[:k] for run, k in zip(runs, upto, strict=True)]), [run[k:] for run, k in zip(runs, upto, strict=True)]
            if not len(popped):
                continue
        else:
            popped, rest = np.arange(m, dtype=np.int32), [heaps[j][:0]] * entries
        rescanned += len(popped)
        own = x[popped, j * width : (j + 1) * width].astype(np.int64)
        far = squared(own, books.entries[j])
        new = far.argmin(axis=1)
        best = np.sqrt(far[np.arange(len(far)), new].astype(float))
        far[np.arange(len(far)), new] = np.iinfo(np.int64).max
        slack = (np.sqrt(far.min(axis=1).astype(float)) if entries > 1 else np.full(len(far), np.inf)) - best
        changed = new != codes[j][popped] if state else np.ones(len(new), bool)
        np.add.at(sums[j], new[changed], own[changed])
        np.add.at(counts[j], new[changed], 1)
        if state:
            np.subtract.at(sums[j], codes[j][popped][changed], own[changed])
            np.subtract.at(counts[j], codes[j][popped][changed], 1)
        codes[j][popped] = new
        keys[j][popped] = np.nextafter((slack + books.drift[j, new]).astype(np.float32), np.float32(-np.inf))
        merged = []
        for e in range(entries):
            fresh = popped[new == e]
            fresh = fresh[np.argsort(keys[j][fresh], kind="stable")]
            merged.append(np.insert(rest[e], np.searchsorted(keys[j][rest[e]], keys[j][fresh]), fresh))
        heaps[j] = np.concatenate(merged)
    return (codes, keys, heaps), sums, counts, rescanned


_STATE = "x binary, codes binary, keys binary, heaps binary, sums binary, counts binary, rescanned long"


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, state: tuple, sums: np.ndarray, counts: np.ndarray, rescanned: int) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    raw = [pa.array([v.tobytes()], pa.binary()) for v in (x, *state, sums, counts)]
    return pa.RecordBatch.from_arrays([one(ids), one(labels), *raw, pa.array([rescanned], pa.int64())], names=["ids", "labels", "x", "codes", "keys", "heaps", "sums", "counts", "rescanned"])


def _packed(books: Codebooks, p: Quantizer):
    """Rows to blocks, assigned for the first time."""
    parts, _, width = books.entries.shape
    most = int((((1 << 63) - 1) // max(1, 4 * parts * width)) ** 0.5) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, p.block):
                batch = whole.slice(k, p.block)
                vectors = batch.column(2)
                if any(n != parts * width for n in vectors.value_lengths().to_pylist()):
                    raise ValueError(f"all vectors must have {parts * width} components")
                x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * p.scale)
                if len(x) and np.abs(x).max() > min(most, (1 << 31) - 1):
                    raise ValueError("components are too large for distances of 64 bits")
                x = x.astype(np.int32).reshape(batch.num_rows, -1)
                yield _block(batch.column(0), batch.column(1), x, *assign(x, books, None))

    return trimmed(run)


def _opened(batch: pa.RecordBatch, k: int, books: Codebooks) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    parts, _, width = books.entries.shape
    of = lambda name, kind: np.frombuffer(batch.column(name)[k].as_py(), kind)
    codes = of("codes", np.uint8).reshape(parts, -1)
    return of("x", np.int32).reshape(codes.shape[1], parts * width), (codes, of("keys", np.float32).reshape(codes.shape), of("heaps", np.int32).reshape(codes.shape))


def _again(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, state = _opened(batch, k, books)
                yield _block(batch.column("ids")[k].values, batch.column("labels")[k].values, x, *assign(x, books, state))

    return trimmed(run)


def _coded(books: Codebooks):
    """Blocks, assigned for the last time, to rows of their vectors."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, state = _opened(batch, k, books)
                (codes, _, _), *_ = assign(x, books, state)
                error = np.zeros(len(x), np.int64)
                for j in range(parts):
                    error += ((x[:, j * width : (j + 1) * width].astype(np.int64) - books.entries[j][codes[j]]) ** 2).sum(axis=1)
                text = codes.T.tobytes().hex()
                hexed = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(hexed, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return trimmed(run)


def _totals(shape: tuple[int, int, int]):
    """A task's changes of sums and counts, added up: a row for each place in the codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
        for batch in batches:
            for sums, counts in zip(batch.column("sums").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total += np.concatenate([np.frombuffer(sums, np.int64), np.frombuffer(counts, np.int64)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "total"])

    return trimmed(run)


def _change(blocks: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Changes of all blocks; as many rows reach the driver as the codebooks have components and entries."""
    out = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
    for row in blocks.select("sums", "counts").mapInArrow(_totals(shape), "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[row["place"]] = row["total"]
    n = shape[0] * shape[1] * shape[2]
    return out[:n].reshape(shape), out[n:].reshape(shape[:2])


def quantized(vectors: DataFrame, p: Quantizer = Quantizer(), told: list | None = None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Rows whose vector is null or holds null or non-finite components are dropped. Codebooks start from the smallest vec_ids, a null
    one last, rows of one vec_id by their vectors; fewer rows than ``entries`` give as many entries. code has two hex digits for each
    part, error is the final squared distance summed over parts, label_error its sum over the rows of a label, nulls
    together. Repeated rows are coded each. An empty table gives an empty table. Vectors of unlike lengths, or of
    a length that ``parts`` does not divide, and components whose distances exceed 64 bits are errors.
    ``told`` takes the number of parts rescanned in each assignment but the last.
    """
    ship(vectors.sparkSession)
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & finite)
    seeds = [r["embedding"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(p.entries).select("embedding").collect()]
    if not seeds:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    if len({len(s) for s in seeds}) > 1 or len(seeds[0]) % p.parts:
        raise ValueError(f"all vectors must have one length, and {p.parts} must divide it")
    books = Codebooks(np.floor(np.array(seeds, float) * p.scale).astype(np.int64).reshape(len(seeds), p.parts, len(seeds[0]) // p.parts).transpose(1, 0, 2).copy())
    schema = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, {_STATE}"
    shape = books.entries.shape
    sums, counts, blocks = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64), None
    for _ in range(p.rounds):
        before, blocks = blocks, cut(rows.mapInArrow(_packed(books, p), schema) if blocks is None else blocks.mapInArrow(_again(books), schema))
        forget(before)
        change = _change(blocks, shape)
        sums, counts = sums + change[0], counts + change[1]
        books = books.updated(sums, counts)
        if told is not None:
            told.append(blocks.agg(F.sum("rescanned")).first()[0])
    coded = cut(blocks.mapInArrow(_coded(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    forget(blocks)
    of_label = cut(coded.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(small(of_label, of_label.count()), F.col("label").eqNullSafe(F.col("its_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
