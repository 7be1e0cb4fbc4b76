"""The training-data operators against plain versions and on awkward rows."""

import base64
import gzip
import hashlib
import json
import random
import urllib.parse
import zlib
from dataclasses import replace

import brute
import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from facetframe.llm import chat, decontaminate, graph, langid, minhash, mixing, quality, queries, secrets, sharding, tokens, toxicity, twins

LONG = "lorem ipsum dolor sit amet " * 40_000
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "river", "stone", "cloud", "table", "green", "seven", "paper", "light"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
    return " ".join(w)


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "ONE"), (7, LONG), (8, LONG + "end"), (9, "12345 !!"), (10, "é"), (11, "a b c d"), (12, "A  b\nc d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names the operators use themselves."""
    rows = spark.createDataFrame(AWKWARD + AWKWARD[:4], "doc_id long, text string")
    extra = {c: F.lit("x") for c in ("score", "kept", "row", "rest", "bucket", "shard", "size", "rank", "bands", "items", "weight")}
    return rows.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.when(F.col("doc_id") > 3, "s"), **extra})


def test_minhash_equals_brute_force(spark, docs):
    base = [prose(k, 60) for k in range(12)]
    rows = [(k, t) for k, t in enumerate([*base, *(edited(base[k % 4], k, 1 + k % 6) for k in range(60)), *base[:3]])]
    for table in (spark.createDataFrame(rows, "doc_id long, text string"), docs):
        want = brute.near_duplicates([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table).collect()}
        assert got == want


def test_minhash_drifting_group(spark):
    """A large group whose members are linked through others only, beyond what one pivot connects."""
    start, rows = prose(1, 150), []
    for k in range(150):
        rows.append((k, edited(start, k, 2 + k % 12)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), replace(minhash.NearDuplicates(), asking=8, asked=16)).collect()}
    assert got == {k: c for k, (_, c) in brute.near_duplicates(rows).items()}


def test_minhash_awkward(spark, awkward):
    got = {r.doc_id: r for r in minhash.near_duplicates(awkward).collect()}
    assert len(minhash.near_duplicates(awkward).collect()) == 16
    assert [got[k].n_shingles for k in (1, 2, 3)] == [0, 0, 0] and all(got[k].kept for k in (1, 2, 3))
    assert got[5].component_id == got[6].component_id == 4 and got[12].component_id == 11 and got[8].component_id == 7
    assert minhash.near_duplicates(awkward.limit(0)).count() == 0


def test_minhash_repeated_and_null_ids(spark):
    """Rows of one doc_id are one document of all their texts; a row of a null doc_id is one of its own."""
    a, b, c = (prose(k, 60) for k in (1, 2, 3))
    rows = [(1, a), (1, b), (3, a + " more"), (4, b + " tail"), (5, c), (5, c), (None, c + " x"), (None, prose(9, 30)), (None, prose(9, 30) + " y"), (None, None), (None, ""), (7, None), (7, None), (8, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_duplicates(table).collect())
    assert got == sorted([(1, 56, 1, True), (1, 56, 1, True), (3, 57, 1, False), (4, 57, 1, False), (5, 56, 5, True), (5, 56, 5, True), (0, 57, 5, False), (0, 26, 0, True), (0, 27, 0, True), (0, 0, 0, True), (0, 0, 0, True), (7, 0, 7, True), (7, 0, 7, True), (8, 56, 1, False)])
    kept = [(r.doc_id, r.text) for r in minhash.deduplicated(table.withColumn("kept", F.lit(1))).collect()]
    assert sorted(x or 0 for x, _ in kept) == [0, 0, 0, 1, 5, 7] and (5, c) in kept and sum(t is None or t == "" for x, t in kept if x is None) == 2


def test_minhash_deduplicated(spark, awkward):
    assert minhash.deduplicated(awkward).columns == awkward.columns
    assert sorted(r.doc_id for r in minhash.deduplicated(awkward).collect()) == [1, 2, 3, 4, 7, 9, 10, 11]
    assert minhash.deduplicated(awkward.limit(0)).count() == 0


def test_signature_is_circulant():
    p = minhash.NearDuplicates()
    second = minhash._shifted(p)[:, 0]
    s = minhash.signature(__import__("numpy").array([12345 << 40], "uint64"), p)
    at = int(__import__("numpy").flatnonzero(second == s[0])[0])
    assert all(s[k] == second[(at + k) % len(second)] for k in range(p.size))


def test_components_of_paths_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50), (60, 61), (60, 61), (None, 3)], "a long, b long")
    for table, held in ((edges, graph.HELD), (edges.repartition(13), graph.HELD), (edges.repartition(5), 3), (edges.repartition(5), 0)):
        # ended in one task, after a few rounds, by rounds alone
        got = {r.node: r.component for r in graph.components(table, held=held).collect()}
        assert got == {**{i: 0 for i in range(41)}, 60: 60, 61: 60}
    maps = [spark.createDataFrame(x, "node long, component long") for x in ([(1, 2), (2, 2), (5, 6)], [(2, 9), (9, 9)], [(9, 8), (7, 7)])]
    assert {tuple(r) for r in graph.composed(maps).collect()} == {(1, 8), (2, 8), (5, 6), (9, 8), (7, 7)}


def test_secrets_base(spark, docs, awkward):
    for table in (docs, awkward):
        texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        for r in secrets.secrets(table).collect():
            want = brute.base_spans(texts[r.doc_id])
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in want) for kind in range(3))
            assert r.base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest()


def test_secrets_planted(spark):
    text = "π Token = 'abcDEF123' AKIA" + "Q7" * 10 + " " + "0f" * 14 + " passwd:short api-key=nothing1"
    got = secrets.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_assign, got.n_access, got.n_hex) == (1, 1, 1) and got.spans == secrets.joined(brute.base_spans(text))


def test_secrets_layers():
    inner = "key api_key: 0123456789 end"
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    for wrapped in (packed, base64.b64encode(base64.b64encode(zlib.compress(inner.encode()))).decode(), base64.b64encode(packed.encode()).decode()):
        text = f"ü see {wrapped} here"
        base, spans, layers, cut = secrets.scan(text)
        assert not base and layers and not cut
        (a, kind, b), *_ = spans
        assert kind == 0 and text[a:b].strip("=") in wrapped
    quoted = urllib.parse.quote(urllib.parse.quote("é token=abcdef99"))
    assert secrets.scan("x " + quoted)[1][0][1] == 0
    a, _, b = secrets.scan(r"x token=abcdef99 y")[1][0]
    assert r"x token=abcdef99 y"[a:b] == r"token=abcdef99"
    for split in ('say secret%3A hunter2x now', r'say {"secret\u0022: \u0022hunter2x\u0022} now'):  # a key and its value in words of their own
        (a, kind, b), *_ = secrets.scan(split)[1]
        assert kind == 0 and split[a : a + 6] == "secret" and split[:b].endswith("hunter2x")
    assert secrets.scan("%zz" + "é" * 300_000)[1] == []  # a long word costs no more than its length
    assert secrets.scan("%25" * 50)[2] >= 1  # ends although each layer makes another
    assert secrets.scan(base64.b64encode(gzip.compress(b"a" * 5000)).decode(), secrets.SecretScan(largest=1000))[3]


def test_secrets_reach_whole_layers(spark):
    """Base64 with other characters around it or over lines, all members, damaged codes and layers beyond a piece."""
    secret, noise = "my token=abcdef99 ok", " ".join(random.Random(4).choices(WORDS, k=90))
    code = lambda raw: base64.b64encode(raw).decode()
    plain = code(secret.encode())
    packed = code(gzip.compress((noise + secret + noise).encode()))
    wrapped = base64.encodebytes(gzip.compress((noise + secret).encode())).decode()
    across = base64.encodebytes(b"x" * 50 + secret.encode()).decode()
    assert "\n" in wrapped[:-1] and "\n" in across[:-1]
    members = code(gzip.compress(b"first") + gzip.compress(secret.encode()))
    for text in (f"see h/p/{plain} now", f"key_{plain}", f"x-{plain}", f"abcde{plain}", f"{plain}/tail", f"see h/p/{packed}", f"k_{packed}", wrapped, across, members, "q%FFtoken%3Dabcdef99"):
        spans = secrets.scan(f"ü {text} !")[1]
        assert any(kind == 0 for _, kind, _ in spans), text
    a, _, b = next(x for x in secrets.scan(f"ü key_{plain} !")[1] if x[1] == 0)
    assert f"ü key_{plain} !"[a:b] in plain and b - a < len(plain)
    for at in (0, 1500, 4980):  # in the first, a middle and the last piece, and over the border of two
        large = b"." * at + secret.encode() + b"." * (5000 - at)
        _, spans, _, cut = secrets.scan(code(gzip.compress(large)), secrets.SecretScan(largest=1000, overlap=64))
        assert cut and any(kind == 0 for _, kind, _ in spans)
    assert any(k == 0 for _, k, _ in secrets.scan(code(gzip.compress(b"." * 990 + secret.encode() + b"." * 900)), secrets.SecretScan(largest=1000, overlap=64))[1])
    row = secrets.secrets(spark.createDataFrame([(1, wrapped), (2, "no\nlong words in here")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert "assign:" in row[0].spans and row[1].n_layers == 0


def test_secrets_unread_layers_are_told():
    """Layers that are not read set ``truncated``; unprintable bytes and long escapes do not hide anything."""
    import lzma

    code = lambda raw: base64.b64encode(raw).decode()
    packed = lzma.compress(b"river stone cloud " * 60 + b"my token=abcdef99 ok", filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 26}])
    small = replace(secrets.SecretScan(), memory=1 << 20)
    assert secrets.scan(f"x {code(packed)} y", small)[1:] == ([], 0, True) and secrets.scan(f"x {code(packed)} y")[1]
    for text in (code(b"\0\1 token=abcdef99 \0 tail"), r"toke\U0000006e\U0000003dabcdef99", code(gzip.compress(b"\0" * 40 + b"token=abcdef99" + b"\xff" * 40))):
        assert any(kind == 0 for _, kind, _ in secrets.scan(text)[1]), text
    assert secrets.scan(r"token\UFFFFFFFFabcdef99")[1] == []


def test_chat_links_and_validates(spark):
    call = {"content": None, "plan": ["z"], "tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q", "limit": 2.0}}, {"id": "b", "name": "search", "arguments": {"limit": "x"}}, {"id": "c", "name": "nope", "arguments": {}}]}
    rows = [(1, 0, "user", "hé \"q\""), (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": 2}})), (1, 2, "assistant", json.dumps(call)), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "r"})), (1, 4, "tool", json.dumps({"tool_call_id": "q", "content": 1})), (1, 5, "assistant", None), (1, 6, "assistant", "{broken")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("calls", F.lit(1))
    got = chat.formatted(table).orderBy("at_turn", "at_call", "turn").collect()
    assert [r.turn for r in got] == [0, 2, 3, 1, 4, 5, 6]
    by = {r.turn: r for r in got}
    assert (by[2].n_calls, by[2].n_invalid) == (3, 2) and by[3].linked and by[1].linked and not by[4].linked
    assert json.loads(by[2].message)["plan"] == ["z"]
    for r in got:
        assert json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message or "2.0" in r.message
    assert chat.formatted(table.limit(0)).count() == 0


def test_chat_awkward_rows(spark):
    """Reused identifiers, answers in excess, repeated rows, calls that depend on each other, null conversations, very long text."""
    one = lambda *calls, **more: json.dumps({"content": "c", "tool_calls": [{"id": i, "name": "fetch", "arguments": {"url": u}} for i, u in calls], **more})
    answer = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [(1, 1, "assistant", one(("x", "u"))), (1, 2, "tool", answer("x", 1)), (1, 3, "assistant", one(("x", "v"))), (1, 4, "tool", answer("x", 2)), (1, 4, "tool", answer("x", 2)), (1, 5, "tool", answer("x", 3))]
    rows += [(2, 1, "assistant", one(("a", "$b"), ("b", "$c"), ("c", "w"))), (2, 2, "tool", answer("a", LONG)), (2, 3, "tool", answer("c", "")), (2, 4, "assistant", one(("p", "$q"), ("q", "$p"), ("r", "$r"), ("s", "t")))]
    rows += [(None, 1, "assistant", one(("n", "u"))), (None, 2, "tool", answer("n", 0)), (3, None, "user", None), (3, 1, None, "hi"), (3, 2, "tool", LONG)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "json": F.lit("x"), "said": F.lit(2)})
    got = chat.formatted(table).collect()
    assert len(got) == len(rows)
    at = sorted((r.conv_id, r.turn, r.at_turn, r.at_call) for r in got if r.linked)
    assert at == [(1, 2, 1, 1), (1, 4, 3, 1), (1, 4, 3, 1), (2, 2, 1, 3), (2, 3, 1, 1)]
    by = {(r.conv_id, r.turn): r for r in got}
    assert [c["id"] for c in json.loads(by[2, 1].message)["tool_calls"]] == ["c", "b", "a"] and by[2, 1].n_invalid == 0
    assert [(c["id"], c["valid"]) for c in json.loads(by[2, 4].message)["tool_calls"]] == [("s", True), ("p", False), ("q", False), ("r", False)]
    assert by[None, 1].n_calls == 1 and by[None, 2].linked is False and by[3, 2].linked is False


SCHEMAS = {
    "book": {"type": "object", "properties": {"seats": {"type": "array", "items": {"type": "object", "properties": {"row": {"type": "integer"}, "kind": {"enum": ["aisle", "window", 3]}}, "required": ["row"]}}, "note": {"type": ["string", "null"]}, "price": {"type": "number"}}, "required": ["seats"]},
    "open": {"type": "object", "properties": {"a/b": {"type": "boolean"}, "a": {"type": "object"}}, "additionalProperties": True},
    "any": {},
}


def test_chat_equals_brute_force(spark):
    r = random.Random(8)
    value = lambda: r.choice([1, 2.0, 2.5, "s", None, True, [], {}, [1], {"row": 1}, "$c1", "$c2"])

    def arguments():
        seat = lambda: r.choice([{"row": r.choice([1, 2.0, 1.5])}, {"row": 1, "kind": r.choice(["aisle", 3, "x"])}, {"kind": "window"}, {"row": 2, "z": 0}, value()])
        given = {k: value() for k in ("note", "price", "a", "a/b", "zz") if r.random() < 0.15} | ({"seats": r.choice([[seat() for _ in range(r.randrange(4))], value()])} if r.random() < 0.8 else {})
        return r.choice([given, given, given, json.dumps(given), value()])

    rows = []
    for conv in range(150):
        for turn in range(r.randrange(2, 14)):
            names = [f"c{r.randrange(4)}" for _ in range(r.randrange(5))]
            call = lambda i: {"id": i, "name": r.choice(["book", "book", "open", "any", "no"]), "arguments": arguments()}
            calls = [call(i) if r.random() < 0.7 else {"id": i, "type": "function", "function": {k: v for k, v in call(i).items() if k != "id"}} for i in dict.fromkeys(names)]
            kind = r.random()
            if kind < 0.35:
                rows.append((conv, turn, "assistant", json.dumps({"content": value(), "tool_calls": calls} | ({"more": value()} if r.random() < 0.3 else {}))))
            elif kind < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{r.randrange(4)}", "content": value()} | ({"x": 1} if r.random() < 0.3 else {}))))
            else:
                rows.append((conv, turn, r.choice(["user", "assistant", "tool"]), r.choice([None, "", "plain", "{not", '["a"]', "{}"])))
    tools = spark.createDataFrame([(k, json.dumps(v)) for k, v in SCHEMAS.items()], "name string, schema string")
    got = {(x.conv_id, x.turn): (x.at_turn, x.at_call, json.loads(x.message), x.n_calls, x.n_invalid, x.linked) for x in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()}
    want = brute.chat(rows, SCHEMAS)
    assert sum(v[3] for v in want.values()) > 300 and {v[5] for v in want.values()} == {None, True, False}
    for k, v in want.items():
        assert got[k] == v, (k, got[k], v)


def test_token_counts(spark, docs, awkward):
    p = replace(tokens.TokenFiles(), block=37, chunk=5)
    encode = tokens.encoding(p).encode_ordinary
    for table, q in ((docs, replace(p, block=997)), (awkward, replace(p, block=4001)), (docs.limit(20), p)):
        want = sorted((r.doc_id, len(encode(r.text or ""))) for r in table.select("doc_id", "text").collect())
        assert sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(table, q).collect()) == want
    assert tokens.token_counts(docs.limit(0), p).count() == 0


def test_separator_scan_of_files(spark, tmp_path):
    import numpy as np

    r = random.Random(3)
    for name, p in (("a", replace(tokens.TokenFiles(), block=8, chunk=3)), ("b", replace(tokens.TokenFiles(), block=8)), ("c", replace(tokens.TokenFiles(), block=7, chunk=1, task_blocks=2, width=4))):
        ids = [r.choice([7, 8, p.separator]) for _ in range(101)] + [9] * 30 + [p.separator, 9]
        (tmp_path / name).mkdir()
        np.array(ids, f"<u{p.width}").tofile(tmp_path / name / "x.bin")
        with open(tmp_path / name / "x.bin", "ab") as f:
            f.write(b"\1")  # an identifier that is cut off
        (tmp_path / name / "empty.bin").touch()
        want, start = [], 0
        for k, x in enumerate(ids):
            if x == p.separator:
                want.append((len(want), start, k - start, True))
                start = k + 1
        want.append((len(want), start, len(ids) - start, False))
        got = tokens.separator_scan(tokens.blocks_of(tokens.token_files(spark, str(tmp_path / name)), p), p).drop("stream").orderBy("ordinal").collect()
        assert [tuple(x) for x in got] == want


def test_mixture(spark, awkward):
    rows = spark.createDataFrame([(i, "x" * 400, "big" if i < 800 else f"s{i % 4}") for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.mixed(rows)
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("tokens").alias("t"), F.first("repetition").alias("rep"), F.first("weight").alias("w"), F.countDistinct("doc_id").alias("n")).collect()}
    assert sum(r.n for r in by.values()) == 1000 and by["big"].rep == 1.0
    total = sum(r.t for r in by.values())
    for r in by.values():
        assert 1 <= r.rep <= 2.000001 and abs(r.t / total - r.w) < 0.02
    assert mixing.mixed(awkward).where("pass = 0").count() == 16 and mixing.mixed(awkward.limit(0)).count() == 0
    assert sorted(mixing.repeated(awkward).columns) == sorted(awkward.columns)


def test_mixture_budget(spark):
    """A budget below and above the corpus: shares as weighted, whole blocks, each row once a pass."""
    rows = spark.createDataFrame([(i, "x" * 400, "big" if i < 1600 else f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    for budget, bins in ((60_000, 1024), (60_000, 1), (900_000, 16)):
        got = mixing.mixed(rows, replace(mixing.Mixture(), budget=budget, bins=bins, blocks=32)).collect()
        assert len(got) == len({(r.doc_id, r["pass"]) for r in got})
        by = {}
        for r in got:
            by[r.source] = by.get(r.source, 0) + r.tokens
        weights = {r.source: r.weight for r in got}
        assert sum(weights.values()) == pytest.approx(1, abs=1e-6)
        assert all(abs(by[k] - w * budget) <= 100 * 1600 / 32 + 100 for k, w in weights.items())
        if budget == 60_000:
            first = {(r.doc_id, r["pass"], r.block, r.block_rank) for r in got} if bins == 1024 else first
            assert first == {(r.doc_id, r["pass"], r.block, r.block_rank) for r in got}


def test_sharding(spark, docs, awkward):
    for table, p in ((docs, sharding.Shards()), (docs, sharding.Shards(groups=40, fan_in=3, chunk=20)), (awkward, sharding.Shards())):
        got = sharding.byte_balanced(table, p).collect()
        assert len(got) == table.count()
        texts = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}
        shard = {}
        for r in got:
            raw = texts[r.doc_id].encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
            assert shard.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < 8
        for s in range(8):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    sums = [sum(r["size"] for r in sharding.byte_balanced(docs).collect() if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= 0.01 * sum(sums)
    assert sharding.byte_balanced(docs.limit(0)).count() == 0


def test_sharding_equals_brute_force(spark, docs):
    """One bucket: the sums of plain differencing over the groups of equal texts."""
    sizes = {}
    for r in docs.select("text").collect():
        sizes[r.text or ""] = sizes.get(r.text or "", 0) + len((r.text or "").encode()) + 1
    want = brute.differencing(sorted(sizes.values(), reverse=True), 8)
    got = sharding.byte_balanced(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert sum(r.s for r in got) == sum(want) and max(r.s for r in got) - min(r.s for r in got) <= max(want) - min(want) + 2
    r = random.Random(4)
    for n, shards in ((1, 2), (9, 2), (40, 3), (200, 8)):
        w = sorted((r.randrange(1, 1 << 40) for _ in range(n)), reverse=True)
        assert sorted(s for s, _ in sharding.difference([[(x, k), *[(0, None)] * (shards - 1)] for k, x in enumerate(w)])) == sorted(brute.differencing(w, shards))


def test_differencing_classic():
    assert [s for s, _ in sharding.difference([[(w, k), (0, None)] for k, w in enumerate([8, 7, 6, 5, 4])])] == [16, 14]


def test_decontamination(spark):
    item = prose(99, 40)
    one = item.split()
    rows = [(1, prose(1, 80) + " " + item + " " + prose(2, 30)), (2, prose(3, 200)), (3, edited(" ".join(one[5:35]), 5, 4).upper()), (4, " ".join(one[:8])), (5, None), (6, ""), (7, "... ".join(one)), (8, LONG)]
    bench = [(10, item), (11, prose(98, 40)), (12, None), (13, "few words")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for p in (decontaminate.SpacedSeeds(), replace(decontaminate.SpacedSeeds(), broadcast_bytes=0)):
        got = {r.doc_id: r["items"] for r in decontaminate.overlaps(d, b, p).collect()}
        assert got == {1: [10], 2: [], 3: [10], 4: [], 5: [], 6: [], 7: [10], 8: []}
    assert decontaminate.overlaps(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.overlaps(d.limit(0), b).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [2, 4, 5, 6, 8]


def test_decontamination_awkward(spark, awkward):
    """Nulls, long texts, repeated rows and items, and columns whose names the operator uses itself."""
    bench = spark.createDataFrame([(1, "one"), (1, "one"), (2, None), (3, ""), (None, "a b c d")], "item_id long, text string").withColumn("doc_key", F.lit(1))
    extra = awkward.withColumns({"doc_key": F.lit("x"), "item_id": F.lit(5), "equal": F.lit(6), "place": F.lit(7)})
    for p in (decontaminate.SpacedSeeds(), replace(decontaminate.SpacedSeeds(), broadcast_bytes=0)):
        got = decontaminate.overlaps(extra, bench, p).collect()
        assert len(got) == 16 and {r.doc_id: r["items"] for r in got if r.contaminated} == {4: [1], 5: [1], 6: [1], 11: [], 12: []}
        assert all(r.contaminated == (r.doc_id in (4, 5, 6, 11, 12)) for r in got)
        kept = decontaminate.clean(extra, bench, p)
        assert kept.columns == extra.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 2, 3, 3, 7, 8, 9, 10]


def test_seeds_hit_every_overlap():
    """Equal / replaced patterns that the verifier accepts: all of up to 17 words, and sparse and random longer ones."""
    import numpy as np

    p, r = decontaminate.SpacedSeeds(), random.Random(5)
    patterns = [[bool(k >> j & 1) for j in range(n)] for n in range(12, 18) for k in range(1 << n) if k & 7 == 7 and k.bit_count() >= 12]
    patterns += [[j % 4 != 3 for j in range(50)], [j == 0 or j % 3 != 0 for j in range(51)]]
    patterns += [[r.random() >= share for _ in range(n)] for n in (15, 24, 38, 60) for share in (0.1, 0.2, 0.25, 0.3) for _ in range(500)]
    accepted = 0
    for pattern in patterns:
        own = np.arange(1, len(pattern) + 1, dtype=np.uint64)
        other = np.where(pattern, own, own + np.uint64(1000))
        if decontaminate._overlap(own, other, 0, p.penalty) >= p.least:
            accepted += 1
            assert any((x == y).any() for x, y in zip(decontaminate._seeded(own, p.masks), decontaminate._seeded(other, p.masks), strict=True)), pattern
    assert accepted > 3000


def test_decontamination_is_whole(spark, docs):
    """Sparse overlaps, items shorter than a seed and, on given texts, exactly the overlaps of brute force."""
    item = prose(99, 60).split()
    every_fourth = " ".join(w if k % 4 != 3 else f"new{k}" for k, w in enumerate(item[:50]))
    rows = [(1, every_fourth), (2, "we say one two three, FOUR and go"), (3, "one two three and four"), (4, "lone " + prose(7, 40)), (5, "lon e"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i x"), (8, None)]
    bench = [(10, " ".join(item)), (11, "one two three four"), (12, "lone"), (13, "a b c d e f g h i j"), (13, "four"), (14, "...")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for p in (decontaminate.SpacedSeeds(), replace(decontaminate.SpacedSeeds(), broadcast_bytes=0)):
        got = {r.doc_id: (r["items"], r.most_equal) for r in decontaminate.overlaps(d, b, p).collect()}
        assert got == {1: ([10], 36), 2: ([11, 13], 4), 3: ([13], 1), 4: ([12], 1), 5: ([], 0), 6: ([13], 10), 7: ([], 0), 8: ([], 0)}
    given = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts, items = docs.where("n_chars < 6000"), given.collect()
    want = {r.doc_id: sorted({b.item_id for b in items if brute.overlaps(r.text, b.text)}) for r in texts.collect()}
    assert {r.doc_id: r["items"] for r in decontaminate.overlaps(texts, given).collect()} == want


def test_language_id(spark, docs, awkward):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got.collect())
    odd = {r.doc_id: r for r in langid.identify(awkward).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (1, 2, 3, 9)) and odd[10].lang_pred == "en"
    assert langid.identify(awkward.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_equal_brute_force():
    """Exact code lengths of random bytes, over trees of unlike order and languages that have seen unlike things."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(2)
    letters = ["abcd e", "abce é", "xyz a", "q"]
    for order in (0, 1, 3, 4):
        p = replace(langid.LanguageModel(), order=order)
        texts = {k: ["".join(r.choice(a) for _ in range(r.choice([0, 1, 3, 200]))) for _ in range(20)] for k, a in enumerate(letters)}
        pairs = [(str(k), t) for k, ts in texts.items() for t in ts]
        r.shuffle(pairs)
        got = pa.Table.from_batches(langid._counted(p)(iter([pa.record_batch({"lang": [k for k, _ in part], "text": [t for _, t in part]}) for part in (pairs[:31], pairs[31:])]))).group_by(["lang", "length", "code"]).aggregate([("n", "sum")])
        trees = langid.Trees([str(k) for k in texts], np.array([int(x) for x in got["lang"].to_pylist()]), *(got[c].to_numpy() for c in ("length", "code", "n_sum")), order)
        asked = ["".join(r.choice("abcdexyzqé \u00ff") for _ in range(r.choice([0, 1, 2, 60, 20_000 if k == 7 else 9]))) for k in range(40)] + pairs[5][1].split("e")
        raw = [x.encode() for x in asked]
        lengths = trees.lengths(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, ts in texts.items():
            follow = brute.contexts([t.encode() for t in ts], order)
            for x, own in zip(raw, lengths, strict=True):
                assert own[k] == pytest.approx(brute.code_length(x, follow, order), rel=1e-9, abs=1e-9)


def test_languages_in_passes(spark, docs):
    """Any number of languages: more than are scored at once are scored in passes, to the same result."""
    many = docs.withColumn("lang", F.concat("lang", F.pmod("doc_id", F.lit(3)).cast("string"))).limit(150)
    want = {r.doc_id: r for r in langid.identify(many).collect()}
    got = {r.doc_id: r for r in langid.identify(many, replace(langid.LanguageModel(), strings=20_000)).collect()}
    assert len(langid.learn(many, replace(langid.LanguageModel(), strings=20_000))) > 2
    assert all((got[k].lang_pred, got[k].held_out) == (r.lang_pred, r.held_out) and got[k].score == pytest.approx(r.score, abs=1e-9) for k, r in want.items()) and len(got) == len(want)


def test_toxicity(spark, docs, awkward):
    bad, rows, labels = ["vile", "nasty"], [], []
    for k in range(600):
        toxic = k % 4 == 0
        w = prose(k, 40).split()
        if toxic:
            w[k % 40] = bad[k % 8 // 4]
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = toxicity.toxicity(d, y).where("held_out").collect()
    assert len(held) > 60 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    odd = toxicity.toxicity(awkward, y.limit(0)).collect()
    assert len(odd) == 16 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity(d.limit(0), y).count() == 0


def test_ftrl_equals_brute_force():
    """Weights of one part, over features counted apart from the operator's arrays, to 1e-9."""
    import numpy as np
    import pyarrow as pa

    p = replace(toxicity.Toxicity(), l1=0.4)
    texts = [prose(k, 12) + (" vile thing" if k % 3 == 0 else "") for k in range(60)] + ["", "one", "one one one one"]
    labels = [float(k % 3 == 0) for k in range(len(texts))]

    def features(text):
        raw = text.encode()
        row, at = toxicity._features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), p)
        words = brute.plain_words(text)
        kinds = {("w", w) for w in words} | {("s", w[:5]) for w in words if len(w.encode()) > 5} | {("p", *x) for x in zip(words, words[1:], strict=False)} | {("k", *x) for x in zip(words, words[2:], strict=False)}
        assert len(set(at.tolist())) == len(kinds) and not row.any()
        return set(at.tolist())

    table = pa.table({"doc_id": [*range(len(texts))], "text": texts, "toxic": labels, "order": [*range(len(texts))]})
    got = dict(zip(*(c.to_pylist() for c in toxicity._trained(p)(table).columns), strict=True))
    want, bias = brute.ftrl(texts, labels, features, p)
    assert got.pop(-1) == pytest.approx(bias, abs=1e-9) and set(got) == set(want) and len(want) > 5
    assert all(got[k] == pytest.approx(w, abs=1e-9) for k, w in want.items())


def test_quality(spark, docs, awkward):
    for table in (docs, awkward):
        texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        for r in quality.quality(table).collect():
            want = brute.quality(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.quality(awkward).count() == 16 and quality.quality(awkward.limit(0)).count() == 0


def test_quality_depletion(spark):
    shared = "\n".join(prose(k, 12) for k in range(3))
    rows = [(k, shared + "\n" + (prose(100 + k, 12) if k < 20 else prose(k, 400)), "h") for k in range(30)] + [(90, shared, "other")]
    rows += [(100 + k, "\n".join(prose(500 + j, 12) for j in range(4)), "copies") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.quality(d).collect()}
    assert not any(got[k] for k in range(20)) and all(got[k] for k in range(20, 30)) and got[90] and not any(got[100 + k] for k in range(40))
    by_text = {r.doc_id: r.kept for r in quality.quality(d, quality.QualityRules(by_text=True)).collect()}
    assert all(by_text[100 + k] for k in range(40)) and all(by_text[k] == got[k] for k in range(30))
    texts = {r.doc_id: r.text for r in quality.cleaned(d.withColumns({"gone": F.lit(1), "kept": F.lit(2)})).collect()}
    assert texts == {**{k: prose(k, 400) for k in range(20, 30)}, 90: shared}


def test_quality_cleaned(spark, awkward):
    """Cleaned texts on awkward rows, and by a plain count of lines on random ones."""
    assert quality.cleaned(awkward).columns == awkward.columns and quality.cleaned(awkward.limit(0)).count() == 0
    r = random.Random(6)
    lines = [prose(k, 4) for k in range(40)] + ["", " ", "A  b C d", "a B\tc d "]
    rows = [(k, "\n".join(r.choices(lines, k=r.randrange(1, 9))), f"h{k % 3}" if k % 7 else None) for k in range(200)]
    norm = lambda x: " ".join(x.lower().split())
    holders = {}
    for k, t, h in rows:
        for x in t.split("\n"):
            if norm(x):
                holders.setdefault((h, norm(x)), set()).add(k)
    want = {}
    for k, t, h in rows:
        n, _, _, _, covered = brute.quality(t)
        left = [x for x in t.split("\n") if not norm(x) or len(holders[h, norm(x)]) <= 8]
        size = lambda xs: sum(len(x) for x in xs if norm(x))
        if n >= 10 and 100 * covered <= 20 * n and size(left) >= 0.3 * size(t.split("\n")):
            want[k] = "\n".join(left)
    got = {x.doc_id: x.text for x in quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"), quality.QualityRules(most_docs=8)).collect()}
    assert got == want and 20 < len(want) < 200


def test_quality_twin_removes_lines(spark, tmp_path):
    """The SQL twin where lines are removed and documents depleted: on both sides of the limit, for hosts of any size."""
    import oracle

    line = {k: prose(900 + k, 12) for k in range(4)}
    rows = [(k, "\n".join([prose(k, 10), *([line[0]] if k < 10 else []), *([line[1]] if k < 11 else [])]), "small") for k in range(30)]
    rows += [(1000 + k, "\n".join([f"only {k} " * 6, *([line[2]] if k < 10 else []), *([line[3]] if k < 12 else [])]), "large") for k in range(3000)]
    rows += [(9000 + k, line[0] + "\n" + line[1], None) for k in range(11)] + [(9100, None, None), (9100, line[0], "small")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.quality(spark.read.parquet(str(tmp_path / "documents.parquet")))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.differences(got, c, twins.QUALITY) == ""
    removed = {r.doc_id for r in got.where("n_chars_removed > 0").collect()}
    assert removed == {*range(11), *range(1000, 1012), *range(9000, 9011), 9100}


@pytest.mark.parametrize("name", sorted(twins.ORACLE_SQL))
def test_twins(spark, name):
    import oracle

    assert oracle.differences(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), twins.ORACLE_SQL[name]) == ""


def test_pipeline(spark, docs):
    """Every stage, on all that the one before has kept, against a plain version."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "minhash_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    spoken = stages["language_id"](spark, docs, SMALL).cache()
    told = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), langid.learn(docs, langid.LanguageModel()), keep=["doc_id"]).collect()}
    assert rows(spoken) == [x for x in rows(docs) if told[x[0]].lang_pred != "und" and told[x[0]].score >= 0.3] and spoken.columns == docs.columns

    single = stages["minhash_dedup"](spark, spoken, SMALL).cache()
    near = brute.near_duplicates(rows(spoken))
    assert rows(single) == [x for x in rows(spoken) if near[x[0]][1] == x[0]] and single.columns == docs.columns and single.count() < spoken.count()

    clean = stages["benchmark_decontamination"](spark, single, SMALL).cache()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    short = lambda df: [x for x in rows(df) if len(x[1] or "") < 3000]  # noqa: E731  the plain version is slow on long texts
    assert short(clean) == [x for x in short(single) if not any(brute.overlaps(x[1], b.text) for b in items)] and clean.columns == docs.columns and clean.count() < single.count()

    mixed = stages["source_mixing"](spark, clean, SMALL).cache()
    times = {k: len({p for *_, p in v}) for k, v in ((k, [(r.doc_id, r["pass"]) for r in mixing.mixed(clean).where(F.col("doc_id") == k).collect()]) for k in [x for x, _ in rows(clean)][:3])}
    assert set(rows(mixed)) == set(rows(clean)) and mixed.columns == docs.columns and all(sum(x == k for x, _ in rows(mixed)) == n for k, n in times.items())

    shards = stages["sharding"](spark, mixed, SMALL).collect()
    texts = dict(rows(clean))
    assert sorted(r.doc_id for r in shards) == [x for x, _ in rows(mixed)] and all(r["size"] == len(texts[r.doc_id].encode()) + 1 for r in shards)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.shard) for r in whole) == sorted((r.doc_id, r.shard) for r in shards)


def test_pipeline_awkward(spark, awkward, tmp_path):
    """Nulls, long texts, repeated rows, clashing names and empty tables in every stage."""
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    table, seen = awkward, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path)).cache()
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
        if name != "sharding":
            assert out.columns == awkward.columns
        seen.append(sorted(r.doc_id for r in out.collect()))
        table = out
    assert seen[0] == [4, 4, 5, 6, 7, 8, 10, 11, 12] and seen[1] == [4, 7, 10, 11] and seen[2] == [7, 10, 11]
    assert set(seen[3]) == {7, 10, 11} and seen[4] == seen[3]
