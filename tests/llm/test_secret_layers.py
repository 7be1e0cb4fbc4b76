"""Secret scans of nested codes: random nestings against their own making, codes that used to be lost, and the time long runs take."""

import base64
import bz2
import gzip
import lzma
import random
import time
import urllib.parse
import zlib

import pytest

from facetframe.llm import secrets

KEY = "to" + "ken"


def thin(data):
    d = zlib.compressobj(9, zlib.DEFLATED, 12)
    return d.compress(data) + d.flush()


def escapes(form):
    return lambda b: "".join(form % c for c in b).encode()


PLAIN = {
    "url": lambda b: urllib.parse.quote(b, safe="").encode(),
    "all url": escapes("%%%02X"),
    "x": escapes("\\x%02x"),
    "u": escapes("\\u%04x"),
    "U": escapes("\\U%08x"),
    "brace": escapes("\\u{%x}"),
    "html": escapes("&#%d;"),
    "base64": base64.b64encode,
    "urlsafe": base64.urlsafe_b64encode,
    "wrapped": lambda b: base64.encodebytes(b).strip(),
}
PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "thin": thin, "bz2": bz2.compress, "xz": lzma.compress}
CARRIERS = ("base64", "urlsafe", "wrapped", "all url", "url", "x")


def nested(r):
    """A secret under one to three codes, compressed ones carried by another: the text, the place of the code and its steps."""
    value = "".join(r.choice("abcdefghijklmnop0123456789") for _ in range(r.randrange(6, 30)))
    inner = f"{KEY}={value}".encode()
    if r.random() < 0.5:
        inner = b"see " + inner + b" here"
    steps = []
    for _ in range(r.randrange(1, 4)):
        if r.random() < 0.4:
            pack, carry = r.choice(list(PACKERS)), r.choice(CARRIERS)
            inner = PLAIN[carry](PACKERS[pack](inner))
            steps += [pack, carry]
        else:
            code = r.choice(list(PLAIN))
            inner = PLAIN[code](inner)
            steps.append(code)
        if len(inner) > 20_000:
            break
    before = "".join(r.choice(["word ", "é ", "x-", "key ", "\n"]) for _ in range(r.randrange(4)))
    text = before + inner.decode() + r.choice(["", " end", "\nlast line"])
    return text, len(before), len(before) + len(inner), steps


def test_random_nestings_are_found():
    r = random.Random(11)
    for k in range(250):
        text, lo, hi, steps = nested(r)
        began = time.perf_counter()
        _, found, layers, _ = secrets.scan(text)
        inside = [s for s in found if s[1] == 0 and lo <= s[0] < s[2] <= hi]
        assert inside and layers, (k, steps, text[:200])
        assert time.perf_counter() - began < 20


def test_bad_codes_do_not_hide_others():
    told = "".join(f"\\u{ord(c):04x}" for c in f"{KEY}=abcdef123456")
    for bad in ("\\ud800", "\\udc00", "\\U00110000", "\\ud800\\ud800", "\\u{110000}", "&#1114112;"):
        for text in (bad + told, told + bad, bad + " " + told):
            assert any(kind == 0 for _, kind, _ in secrets.scan(text)[1]), text
    both = "\\ud83d\\ude00" + told
    assert secrets.scan(both)[1] and "\U0001f600" in secrets._unescaped("\\ud83d\\ude00")[0]


def test_compressed_under_codes():
    secret = f"{KEY}=abcdef123456 ".encode() * 3
    for pack in PACKERS.values():
        for code in ("url", "all url", "x"):
            text = PLAIN[code](pack(secret)).decode()
            found = secrets.scan(f"é {text} end")[1]
            assert found and all(2 <= a < b <= 2 + len(text) for a, _, b in found), code


@pytest.mark.parametrize("run", ["a", "Zm9v", "/+a1", "0123456789abcdef", "\\x41", "%41", "ab\n"])
def test_time_grows_with_the_run(run):
    """2 MB of one run end in seconds."""
    began = time.perf_counter()
    secrets.scan(run * (2_000_000 // len(run)))
    assert time.perf_counter() - began < 30
