"""Vector codes against a version that takes every distance."""

import random

import brute
import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from facetframe.llm import quantize

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(seed, n, width=16):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    return [(k * 3 % n, [round(x + r.gauss(0, 0.05), 3) for x in centres[k % 9]], k % 4 or None) for k in range(n)]


def test_codes_equal_brute_force(spark):
    for rows in (clustered(1, 400), clustered(2, 60, 8)):
        assert rows_of(quantize.quantized(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute.vector_codes(rows)


def test_codes_awkward(spark):
    """Nulls, non-finite components, ties, repeated rows and ids, clashing names, few rows, an empty table."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0] * 7 + [None], 1), (3, [nan] + [0.0] * 7, 2), (4, [0.0] * 7 + [-inf], None)]
    rows += [(5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (5, [-0.25] * 8, None), (None, [0.1] * 8, None), (6, [-0.0001] * 8, 3), (7, [0.25, -0.25] * 4, 1)]
    many = rows + [(k % 30, [((k * j) % 5) / 4 for j in range(8)], k % 2) for k in range(100)]
    for some in (rows, many, rows[:4], []):
        table = spark.createDataFrame(some, SCHEMA).withColumns({c: F.lit("x") for c in ("code", "error", "ids", "labels", "x", "its_label")})
        assert rows_of(quantize.quantized(table)) == brute.vector_codes(some)


def test_wrong_vectors_are_errors(spark):
    table = lambda rows: quantize.quantized(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(ValueError):
        table([(1, [0.0] * 9, 1)])
    with pytest.raises((PythonException, Exception), match="components"):
        table([(k, [0.0] * (8 if k < 20 else 16), 1) for k in range(30)])
    with pytest.raises((PythonException, Exception), match="too large"):
        table([(k, [float(10**k)] * 8, 1) for k in range(12)])


def test_heaps_spare_most_parts(spark):
    """Parts of well-kept clusters are not rescanned, though entries move; the heaps stay in order."""
    told = []
    rows = clustered(4, 3000)
    quantize.quantized(spark.createDataFrame(rows, SCHEMA).coalesce(1), told=told)
    assert told[0] == 8 * 3000 and min(told) < 8 * 3000 / 4
    x = np.array([[int(4096 * v) for v in r[1]] for r in rows])
    books = quantize.Codebooks(x[:16].reshape(16, 8, 2).transpose(1, 0, 2).copy())
    state, sums, counts = None, 0, 0
    for _ in range(5):
        state, s, c, _ = quantize.assign(x, books, state)
        sums, counts = sums + s, counts + c
        for j in range(8):
            full = quantize.squared(x[:, 2 * j : 2 * j + 2], books.entries[j])
            assert (state[0][j] == full.argmin(axis=1)).all() and sorted(state[2][j]) == list(range(len(x)))
            run = list(zip(state[0][j][state[2][j]], state[1][j][state[2][j]], strict=True))
            assert run == sorted(run)
        books = books.updated(sums, counts)
