"""Secret scans through nested encodings.

A text is the first layer of a worklist. Each layer is scanned; what is URL-encoded, escaped, base64 or compressed in it
is unwrapped to further layers, until none is new. Every layer carries, for each of its characters, the range of the
original text that it comes from, so spans found deep inside are reported there.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import blocks, trimmed, utf8, words


@dataclass(frozen=True)
class SecretScan:
    """``run``: characters from which a base64 run is tried. ``largest``: bytes of a compressed layer that are held at
    once; a larger one is read to its end in pieces that overlap by ``overlap`` bytes, and the row says so in ``truncated``,
    as a match across pieces may be reported as its parts. So does it where an xz stream needs more than ``memory`` bytes
    and is not read.
    """

    run: int = 16
    largest: int = 1 << 26
    overlap: int = 1 << 12
    memory: int = 1 << 28


# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_ESCAPES = re.compile(f"(?:{_ONE.pattern})+")
_BYTE = re.compile(rb"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})")
_BASE64 = "A-Za-z0-9+/_-"
#: Runs over line ends. They begin where no run goes on, so that each is looked at once.
_LINES = re.compile(rf"(?<![{_BASE64}])[{_BASE64}]++(?:\r?\n[{_BASE64}]++)++={{0,2}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain matches in ``text``; ``kind`` indexes KINDS."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


#: One character of UTF-8, or one byte that is of none.
_CHARACTER = re.compile(rb"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}|[\x80-\xFF]")
_READABLE = re.compile(rb"(?:[\x09-\x0D\x20-\x7E]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+")
#: Heads of zlib streams: deflate, a window of 32 KB at most, no dictionary, both bytes divisible by 31.
_ZLIB = frozenset(bytes([a, b]) for a in range(0x08, 0x88, 0x10) for b in range(256) if (256 * a + b) % 31 == 0 and not b & 0x20)
_PACKED = re.compile(rb"\x1F\x8B\x08|BZh[1-9]|\xFD7zXZ\x00|" + b"|".join(map(re.escape, sorted(_ZLIB))))
#: Bytes of the shortest match of a kind (token=123456), and so of a stretch that is looked at amid others.
LEAST = 12


def _readable(raw: bytes) -> list[tuple[int, str]]:
    """Position and text of the stretches of ``raw`` that are text: all of it, or those of ``LEAST`` bytes or more."""
    return [(m.start(), m[0].decode("utf-8")) for m in _READABLE.finditer(raw) if len(m[0]) >= min(LEAST, len(raw))]


def _opener(raw, memory: int):
    if raw[:2] == b"\x1f\x8b" or bytes(raw[:2]) in _ZLIB:
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=memory) if raw[:6] == b"\xfd7zXZ\x00" else None


def _pieces(raw, p: SecretScan) -> Iterator[tuple[bytes, bool]]:
    """What ``raw`` holds below one compression, all members one after the other, and whether more than one piece.

    A stream that is broken off or damaged gives what can be read of it; one that needs too much memory an empty piece.
    """
    held, fresh, many, overlap = bytearray(), False, False, min(p.overlap, p.largest // 2)
    while (d := _opener(raw, p.memory)) is not None:
        feed, raw = raw, b""
        try:
            while not d.eof:
                out = d.decompress(feed, max(1, p.largest - len(held)))
                feed = getattr(d, "unconsumed_tail", b"")
                held += out
                fresh |= bool(out)
                if len(held) >= p.largest and not d.eof:
                    many = True
                    yield bytes(held), True
                    held, fresh = held[len(held) - overlap :], False
                elif not out and not feed:
                    break
            raw = d.unused_data if d.eof else b""
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError) as e:
            if "limit" in str(e):
                yield b"", True
    if fresh:
        yield bytes(held), many


def unwrap(raw, p: SecretScan, seen: set[bytes]) -> Iterator[tuple[str, bool]]:
    """Texts below all compression of ``raw``, which begins with a compressed stream, and whether one was read in pieces."""
    work = [raw]
    while work:
        for piece, many in _pieces(work.pop(), p):
            if (mark := hashlib.sha256(piece).digest()) in seen:
                continue
            seen.add(mark)
            if not piece:
                yield "", many
            if _opener(piece, p.memory) is not None:
                work.append(piece)
            for _, text in _readable(piece):
                yield text, many


def peel(token: bytes, p: SecretScan) -> Iterator[tuple[int, str, bool, bool]]:
    """Texts in a base64 token that may have other characters in front and behind: where the text's first byte is in eighths
    of a byte over 6 (bits) of the token, the text, whether it was compressed, and whether it was read in pieces.
    """
    body = token.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    seen: set[bytes] = set()
    for skip in range(4):
        part = body[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        if len(part) < 2:
            break
        raw = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
        for at, text in _readable(raw):
            if not skip or len(text.encode()) >= LEAST:
                yield 6 * skip + 8 * at, text, False, False
        for m in _PACKED.finditer(raw):
            for text, many in unwrap(memoryview(raw)[m.start() :], p, seen):
                yield 6 * skip + 8 * m.start(), text, True, many


#: A text and, for each of its characters, where it starts and ends in the original text.
Layer = tuple[str, np.ndarray, np.ndarray]
#: The characters that a run of codes stands for, and where each one's codes start and end in the run.
Decoded = tuple[str, list[int], list[int]]


def _stretches(text: str, runs: re.Pattern) -> list[tuple[int, int]]:
    """Words of ``text`` that hold a run, and all of it where it has more: a key and its value may be words of their own."""
    found = [w.span() for w in _WORD.finditer(text) if runs.search(text, *w.span())]
    return found if not found or found == [(0, len(text))] else [*found, (0, len(text))]


def _replaced(layer: Layer, lo: int, hi: int, runs: re.Pattern, decode: Callable[[str], Decoded | None]) -> Layer | None:
    """The stretch lo..hi with every run that ``decode`` can read in its place; None if there is none."""
    text, start, end = layer
    chars: list[str] = []
    first: list[np.ndarray] = []
    last: list[np.ndarray] = []
    at = lo
    for m in runs.finditer(text, lo, hi):
        if got := decode(m[0]):
            k = m.start()
            chars += [text[at:k], got[0]]
            first += [start[at:k], start[k + np.array(got[1])]]
            last += [end[at:k], end[k + np.array(got[2]) - 1]]
            at = m.end()
    if at == lo:
        return None
    return "".join([*chars, text[at:hi]]), np.concatenate([*first, start[at:hi]]), np.concatenate([*last, end[at:hi]])


def _percent(run: str) -> Decoded:
    """Bytes that are of no character stand for one each."""
    found = _CHARACTER.findall(bytes.fromhex(run.replace("%", "")))
    ends = [*accumulate(3 * len(c) for c in found)]
    return "".join(c.decode("utf-8", "replace") for c in found), [0, *ends[:-1]], ends


def _unescaped(run: str) -> Decoded:
    """Codes that are of no character, lone surrogates and those beyond the last one, stand for a replacement character."""
    codes: list[int] = []
    first: list[int] = []
    last: list[int] = []
    for m in _ONE.finditer(run):
        code = int(m[m.lastindex], 10 if m.lastindex == 7 else 16)
        if codes and 0xDC00 <= code < 0xE000 and 0xD800 <= codes[-1] < 0xDC00:
            codes[-1] = 0x10000 + ((codes[-1] - 0xD800) << 10) + code - 0xDC00
            last[-1] = m.end()
        else:
            codes.append(code)
            first.append(m.start())
            last.append(m.end())
    return "".join("\ufffd" if 0xD800 <= c < 0xE000 or c > 0x10FFFF else chr(c) for c in codes), first, last


def _packed(layer: Layer, lo: int, hi: int, p: SecretScan, seen: set[bytes]) -> Iterator[tuple[Layer, bool]]:
    """Layers below compressed streams whose bytes are written as codes, or as themselves, in the stretch lo..hi."""
    text, start, end = layer
    plain = text[lo:hi].encode("utf-8", "replace")
    raw = _BYTE.sub(lambda m: bytes([int(m[m.lastindex], 16)]), plain)
    heads = [m.start() for m in _PACKED.finditer(raw)]
    if not heads:
        return
    # where each byte of the stretch, and so of what it stands for, is in the text
    of_byte = np.repeat(np.arange(lo, hi), [len(c.encode("utf-8", "replace")) for c in text[lo:hi]])
    size = np.ones(len(plain), np.int64)
    for m in _BYTE.finditer(plain):
        size[m.start() + 1 : m.end()] = 0
    place = of_byte[np.flatnonzero(size)]
    for head in heads:
        for inner, many in unwrap(memoryview(raw)[head:], p, seen):
            if many or len(inner) >= LEAST // 4:
                yield (inner, np.broadcast_to(start[place[head]], len(inner)), np.broadcast_to(end[hi - 1], len(inner))), many


def _inner(layer: Layer, p: SecretScan) -> Iterator[tuple[Layer, bool]]:
    """Layers that one layer wraps, and whether it was read in pieces. Base64 is read within a line and over lines."""
    text, start, end = layer
    unpacked: set[bytes] = set()
    for marks, runs, decode in ((("%",), _PERCENT, _percent), (("\\", "%u", "&#"), _ESCAPES, _unescaped)):
        for lo, hi in _stretches(text, runs) if any(k in text for k in marks) else []:
            if got := _replaced(layer, lo, hi, runs, decode):
                yield got, False
            yield from _packed(layer, lo, hi, p, unpacked)
    for pattern in (rf"[{_BASE64}]{{{p.run},}}+={{0,2}}", _LINES):
        for m in re.finditer(pattern, text):
            place = np.flatnonzero(~np.isin(np.frombuffer(m[0].encode(), np.uint8), (10, 13))) + m.start()
            if len(place) < p.run:
                continue
            for bit, inner, packed, many in peel(re.sub(r"[\r\n]", "", m[0]).encode(), p):
                if packed:
                    yield (inner, np.broadcast_to(start[place[bit // 6]], len(inner)), np.broadcast_to(end[place[-1]], len(inner))), many
                else:
                    point = np.frombuffer(inner.encode("utf-32-le"), np.uint32)
                    size = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
                    upto = np.cumsum(size)
                    last = len(place) - 1
                    yield (inner, start[place[np.minimum(last, (bit + 8 * (upto - size)) // 6)]], end[place[np.minimum(last, -(-(bit + 8 * upto) // 6) - 1)]]), False


def _known(text: str) -> str | bytes:
    """What a layer is known by: its text, or a digest of a long one, which need not stay in memory."""
    return text if len(text) < 4096 else hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def scan(text: str, p: SecretScan = SecretScan()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, bool]:
    """Base spans, all spans, layers below the text and whether a layer was read in pieces.

    The worklist ends: a layer whose text and origin have been seen is not entered again.
    """
    base = base_spans(text)
    found, seen, cut = set(base), {(_known(text), 0, len(text))}, False
    work = [_inner((text, np.arange(len(text)), np.arange(1, len(text) + 1)), p)]  # a path of layers: siblings are made when it is their turn
    layers = 0
    while work:
        got = next(work[-1], None)
        if got is None:
            work.pop()
            continue
        inner, stopped = got
        cut |= stopped
        if not inner[0] or (mark := (_known(inner[0]), int(inner[1][0]), int(inner[2][-1]))) in seen:
            continue
        seen.add(mark)
        layers += 1
        found.update((int(inner[1][a]), kind, int(inner[2][b - 1])) for a, kind, b in base_spans(inner[0]))
        work.append(_inner(inner, p))
    return base, sorted(found), layers, cut


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


_CLASS = np.ones(256, bool)  # outside base64
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"]] = False
_MARKS = np.zeros(256, bool)
_MARKS[[*b":=%\\&"]] = True


def _wanted(data: np.ndarray, offsets: np.ndarray, p: SecretScan) -> np.ndarray:
    """Rows that may hold a span or a layer: all others have none. Base64 goes on over line ends."""
    marks = np.concatenate([[0], np.cumsum(_MARKS[data])])
    rows = marks[offsets[1:]] > marks[offsets[:-1]]
    starts, ends, row = words(np.where(_CLASS[data], np.uint8(0x20), np.uint8(0x41)), offsets)
    rows[row[ends - starts >= p.run]] = True
    return rows


_EMPTY = hashlib.sha256(b"").hexdigest()


def _scanned(p: SecretScan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out: list[tuple] = []
            for i, j in blocks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                for r, wanted in enumerate(_wanted(part, own, p)):
                    if not wanted:
                        out.append((0, 0, 0, _EMPTY, "", 0, False))
                        continue
                    base, every, layers, cut = scan(part[own[r] : own[r + 1]].tobytes().decode("utf-8", "replace"), p)
                    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                    out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers, cut))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "truncated"])

    return trimmed(run)


def secrets(docs: DataFrame, p: SecretScan = SecretScan()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers and truncated of every row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. The counts and the digest are of the plain matches in the
    text, leftmost and not overlapping for each kind; spans has these and those mapped from decoded layers, as
    ``kind:start:end`` in code points of the text, by start, kind and end, each once. A null text is an empty one: no span,
    the digest of nothing. The time taken grows with the text, whatever its runs are. UTF-16 inside base64, bare LZMA streams and streams with
    a preset dictionary are not read. Repeated rows are scanned each. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text"))
    return rows.mapInArrow(_scanned(p), f"doc_id {rows.dtypes[0][1]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, truncated boolean")
