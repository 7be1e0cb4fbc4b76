"""SimHash fingerprints and groups against bit-by-bit versions over all pairs."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from facetframe.llm import graph, simhash


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprints_equal_bit_by_bit():
    texts = [None, "", " \t\n", "One", "one two THREE", "a b c d", "A\tb\nc  d é", "É x y z", "x " * 70_000 + "y", "  wide blank is a word"]
    r = random.Random(1)
    texts += [" ".join(r.choice("alpha beta gamma delta é Ω".split()) + str(r.randrange(9)) for _ in range(r.randrange(40))) for _ in range(60)]
    got = simhash.fingerprints(pa.array(texts), simhash.SimHash())
    assert [int(x) for x in got] == [brute.simhash(t) for t in texts]
    assert [int(x) for x in simhash.fingerprints(pa.array([None, *texts])[1:], simhash.SimHash())] == [int(x) for x in got]


def clustered(seed, n, groups):
    """Distinct fingerprints: random ones, and chains of a few bits from one to the next."""
    r, out = random.Random(seed), []
    centres = [r.getrandbits(64) for _ in range(groups)]
    for k in range(n):
        x = r.getrandbits(64) if k % 3 == 0 else centres[k % groups]
        for _ in range(r.randrange(9)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return sorted({*out, 0, (1 << 64) - 1})


def test_tables_discard_no_link():
    """Whatever the distances discard is no pair, whoever asks."""
    p = simhash.SimHash()
    x = np.array(clustered(3, 900, 4), np.uint64)
    asks = np.array([k % 3 == 0 for k in range(len(x))])
    for who in (np.ones(len(x), bool), asks):
        a, b = simhash.near(x, simhash.distances(x, p), who, p)
        want = {(i, j) for i in range(len(x)) for j in range(i) if (int(x[i]) ^ int(x[j])).bit_count() <= 4 and (who.all() or who[i] != who[j])}
        assert {(max(i, j), min(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == want


@pytest.mark.parametrize("p", [simhash.SimHash(), simhash.SimHash(crowd=8, cuts=2, side=16), simhash.SimHash(crowd=40, cuts=1, side=30)])
def test_links_connect_as_all_pairs_do(spark, p):
    """Crowded segments, cut again and dealt to blocks, lose no link."""
    x = clustered(5, 500, 3)
    table = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in x], "print long")
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in graph.components(simhash.linked(table, p)).collect()}
    root = {k: k for k in x}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(x):
        for b in x[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    sets = {}
    for k in x:
        sets.setdefault(find(k), set()).add(k)
    mine = {}
    for k in x:
        mine.setdefault(got.get(k, k), set()).add(k)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, mine.values()))


def test_simhash_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = brute.simhash_groups([tuple(r) for r in docs.collect()])
    assert rows_of(simhash.near_duplicates(docs)) == want and any(doc != least for doc, _, least in want)


def test_simhash_awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, an empty table."""
    rows = [(1, None), (2, ""), (None, " "), (3, "one"), (3, "one"), (3, "two words"), (None, "alone here"), (9, "lorem ipsum dolor sit amet " * 40_000), (8, "lorem ipsum dolor sit amet " * 40_000 + "end")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("print", "component_id", "least", "bucket", "way", "n")})
    assert rows_of(simhash.near_duplicates(table)) == brute.simhash_groups(rows)
    assert simhash.near_duplicates(table.limit(0)).count() == 0
