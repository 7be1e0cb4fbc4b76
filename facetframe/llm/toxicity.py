"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Workers learn on parts of a bounded sample, each with per-coordinate rates and L1; their weights are averaged. What
is left is sparse: a few thousand coordinates, which are broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import blocks, hashes, mix, plain, trimmed, utf8, windows, words
from ._common import crc_mod, cut, small


@dataclass(frozen=True)
class Toxicity:
    """``train_rows``: labelled rows that are learned from, about, chosen by a hash of doc_id; ``part_rows`` of them, or
    ``part_bytes`` of text, go to a worker.

    ``bits``: of a feature's coordinate, which bounds the weights that are broadcast; ``stem``: bytes of a longer word's
    beginning that are a feature too. ``l1`` keeps a coordinate at 0 until its gradients add up to more.
    """

    train_rows: int = 40_000
    part_rows: int = 8_000
    part_bytes: int = 32_000_000
    bits: int = 22
    stem: int = 5
    passes: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 2.5
    l2: float = 0.1
    held_out: int = 0
    folds: int = 5


def _features(data: np.ndarray, offsets: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every feature: words, stems, neighbouring pairs and pairs that skip a word."""
    part = plain(data)
    starts, ends, row = words(part, offsets)
    h = hashes(part, starts, ends)
    long = np.flatnonzero(ends - starts > p.stem)
    found = [(row, h), (row[long], hashes(part, starts[long], starts[long] + p.stem))]
    for kind, span in ((2, 2), (3, 3)):
        w = windows(h, (0, span - 1), span, seed=kind)
        one = row[: len(w)] == row[span - 1 :]
        found.append((row[: len(w)][one], w[one]))
    salted = [mix(x ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k, (_, x) in enumerate(found)]
    return np.concatenate([r for r, _ in found]), (np.concatenate(salted) >> np.uint64(64 - p.bits)).astype(np.int64)


def _trained(p: Toxicity):
    """A part's rows (doc_id, text, toxic) to its non-zero weights; coordinate -1 is the bias."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        data, offsets = utf8(rows.column("text").combine_chunks())
        y = rows.column("toxic").to_numpy().astype(np.float64)
        each: list[np.ndarray] = []
        for i, j in blocks(offsets):
            row, at = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(j - i + 1))
            each += [np.unique(at[order[cut[k] : cut[k + 1]]]).astype(np.int32) for k in range(j - i)]
        z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
        bias, bias_n = 0.0, 0.0
        for _ in range(p.passes):
            for k, at in enumerate(each):
                zz, nn = z[at], n[at]
                root = np.sqrt(nn)
                w = np.where(np.abs(zz) <= p.l1, 0.0, -(zz - np.sign(zz) * p.l1) / ((p.beta + root) / p.alpha + p.l2))
                g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y[k]
                z[at] = zz + g - (np.sqrt(nn + g * g) - root) / p.alpha * w
                n[at] = nn + g * g
                bias_n += g * g
                bias -= p.alpha * g / (p.beta + np.sqrt(bias_n))
        at = np.flatnonzero(np.abs(z) > p.l1)
        w = -(z[at] - np.sign(z[at]) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        return pa.table({"at": pa.array(np.append(at, -1)), "w": pa.array(np.append(w, bias))})

    return run


def learn(docs: DataFrame, labels: DataFrame, p: Toxicity) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias. Without rows of both labels no coordinate has a weight."""
    known = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", p.folds) != p.held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("learn")), F.lit(1_000_000))
    share = min(1.0, p.train_rows / max(1, known.count()))
    chosen = cut(known.withColumn("order", order).where(F.col("order") < share * 1_000_000))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(chosen, chosen.count()), "doc_id")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, ceil(n / p.part_rows), ceil(size / p.part_bytes))
    rows = rows.select("doc_id", "text", F.col("toxic").cast("double").alias("toxic"), "order", F.pmod(F.col("order"), F.lit(parts)).alias("part"))
    weights = rows.groupBy("part").applyInArrow(_trained(p), "at long, w double").groupBy("at").agg((F.sum("w") / parts).alias("w"))
    got = weights.toArrow()  # 2^bits rows at most
    at, w = got.column("at").to_numpy(), got.column("w").to_numpy()
    bias = float(w[at == -1].sum())
    order = np.argsort(at[at >= 0])
    return at[at >= 0][order], w[at >= 0][order], bias


def _scored(model, p: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = model.value
        weight = np.zeros(1 << p.bits, np.float32)
        weight[at] = w
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            total = np.full(batch.num_rows, bias)
            for i, j in blocks(offsets):
                row, feature = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)
                hit = np.flatnonzero(weight[feature])
                both = np.unique((row[hit] << p.bits) | feature[hit])  # a feature counts once in a text
                total[i:j] += np.bincount(both >> p.bits, weight[both & ((1 << p.bits) - 1)].astype(np.float64), j - i)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return trimmed(run)


def toxicity(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    Learns from ``labels`` (doc_id, toxic) whose crc32 of doc_id modulo ``folds`` is not ``held_out``; of labels that
    disagree on a doc_id the larger counts, null labels and labels without a document are left out. Null and empty texts,
    or all texts when there are no labels, get the score of the bias alone. Repeated rows are scored each. Only the text
    is an input of the score. An empty table gives an empty table.
    """
    spark = ship(docs.sparkSession)
    model = spark.sparkContext.broadcast(learn(docs, labels, p))
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", p.folds) == p.held_out, F.lit(False)).alias("held_out"), F.col("text"))
    return rows.mapInArrow(_scored(model, p), ", ".join([f"doc_id {rows.dtypes[0][1]}", "held_out boolean, score double, predicted int"]))
