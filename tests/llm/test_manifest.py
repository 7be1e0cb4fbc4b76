"""Merkle manifests against a plain tree."""

import zlib

import brute
import pytest
from pyspark.sql import functions as F

from facetframe.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(n):
    langs = [None, "", "en", "en", "en", "de", "é"]
    return [(k, f"s{k % 3}" if k % 5 else None, langs[k * 7 % 11 % 7], None if k % 4 == 1 else k, None if k % 6 == 2 else "text " * (k % 9)) for k in range(n)]


AWKWARD = [(None, None, None, None, None), (None, "s", None, 1, ""), (7, "s", "en", 2**63 - 1, "x" * 2_000_000), (7, "s", "en", 5, "é\u0000\U0001f600"), (-3, "", "", -1, " ")]


@pytest.mark.parametrize("n", [0, 1, 3, 130])
@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_equals_plain_tree(spark, n, levels):
    """Trees of any size, null and empty langs, in blocks that end at and between their levels."""
    rows = made(n)
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), manifest.Merkle(levels=levels))
    assert rows_of(got) == brute.merkle(rows)


def test_manifest_awkward(spark):
    """Nulls everywhere, long texts, ties, repeated rows, clashing names."""
    rows = AWKWARD + AWKWARD + made(9) + [AWKWARD[3]] * 5
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "at", "leaf", "root", "digest", "size", "block", "id", "claim")})
    assert rows_of(manifest.manifest(table, manifest.Merkle(levels=2))) == brute.merkle(rows)


def test_manifest_verifies(spark):
    """Only what was changed fails, and a wider arity folds too."""
    rows = made(60)
    for p in (manifest.Merkle(), manifest.Merkle(arity=5, levels=1)):
        got = {r.doc_id: r for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA), p).collect()}
        for k, row in enumerate(rows):
            changed = zlib.crc32(str(k).encode()) % 7 == 0 and row[3] is not None
            assert got[k].verified != changed and (got[k].folded_root == got[k].root) == got[k].verified
        assert len({r.root for r in got.values()}) == 1


def test_manifest_root_tells_order_and_content(spark):
    rows = made(30)
    root = lambda x: manifest.manifest(spark.createDataFrame(x, SCHEMA).repartition(4)).first()["root"]
    assert root(rows) == root(rows[::-1]) != root(rows[:-1])
