"""Language identification by prediction by partial matching over bytes.

Every language has a tree of the byte contexts that follow each other in its documents, of variable order: the longest known
context codes a byte, or an escape to the next shorter one (method C with exclusion), down to all 256 bytes alike. The
trees are frozen after learning, so the code length of a text is a sum over its bytes.

A context and the byte after it are one string, so a tree is a table of strings, looked up by the bytes that end at a position.
As all bytes seen after a context are seen after its suffixes, exclusion depends on two neighbouring contexts only. So what a
string costs, and what the way down from a context does, is known beforehand: a position takes one or two table entries.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path, ship
from ._bytes import blocks, trimmed, utf8
from ._common import crc_mod, cut, place_of, small, without

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``train_rows``: about so many labelled documents of each language are learned from, chosen by a hash of doc_id.

    ``order``: bytes of the longest context, 6 at most. ``strings``: counted strings of the languages that are scored at once
    (about 100 bytes each in a worker); languages beyond them are scored in a pass of their own over the documents.
    """

    train_rows: int = 4000
    order: int = 3
    strings: int = 2_000_000
    held_out: int = 1
    folds: int = 3


#: Positions that are scored at once.
STEP = 1 << 14


def _codes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ``length`` bytes inside rows as numbers, and the positions where they end."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(data) - length + 1, np.int64)
    for k in range(length):
        code = (code << 8) | data[k : len(data) - length + 1 + k]
    end = np.arange(length - 1, len(data))
    first = np.repeat(offsets[:-1], np.diff(offsets))  # where a position's row begins
    inside = end - length + 1 >= first[end]
    return code[inside], end[inside]


def _counted(p: LanguageModel):
    """Counts of the strings of 1 to ``order`` + 1 bytes by language (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for lang in sorted(set(langs)):
                rows = [k for k, x in enumerate(langs) if x == lang]
                own = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in rows])
                ends = np.concatenate([[0], np.cumsum([offsets[k + 1] - offsets[k] for k in rows])])
                for length in range(1, p.order + 2):
                    code, n = np.unique(_codes(own, ends, length)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), length, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "length", "code", "n"])

    return trimmed(run)


class _Strings:
    """Numbers of known codes: looked up in a table with open places, twice as large at least."""

    def __init__(self, code: np.ndarray) -> None:
        self.code = code
        bits = max(4, int(2 * len(code)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(code))
        place = self._first(code)
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]  # of those that meet in a slot the last stays
            missed = self.slots[place] != left
            left, place = left[missed], (place[missed] + 1) & self.mask

    def _first(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The number of each code, -1 for unknown ones."""
        out = np.full(len(code), -1, np.int32)
        left = np.arange(len(code))
        place = self._first(code)
        while len(left):
            there = self.slots[place]
            hit = (there >= 0) & (self.code[there] == code[left])
            out[left[hit]] = there[hit]
            on = (there >= 0) & ~hit
            left, place = left[on], (place[on] + 1) & self.mask
        return out


class Trees:
    """Code lengths of a few languages: by string (of a length) and language. Index 0 of ``length`` k is the string of k bytes."""

    def __init__(self, langs: list[str], lang: np.ndarray, length: np.ndarray, code: np.ndarray, n: np.ndarray, order: int) -> None:
        self.langs, self.order = langs, order
        width = len(langs)
        self.strings: list[_Strings | None] = [None]
        counts = []
        for m in range(1, order + 2):
            mine = length == m
            known, at = np.unique(code[mine], return_inverse=True)
            self.strings.append(_Strings(known))
            counts.append(np.bincount(at * width + lang[mine], n[mine], len(known) * width).reshape(-1, width))
        with np.errstate(divide="ignore"):
            self.bits = [None, *(np.log2(c) for c in counts)]  # of a string's count
        codes = [np.zeros(1, np.int64), *(s.code for s in self.strings[1:])]
        # by context: its symbols' counts and kinds, and of those in the next shorter context that are seen in it too
        total, kinds, over = [], [], []
        for m in range(order + 1):
            after, own = self.strings[m + 1].code, counts[m]
            parent = self._find(m, after >> 8) if m else np.zeros(len(after), np.int64)
            total.append(np.zeros((len(codes[m]), width)))
            kinds.append(np.zeros((len(codes[m]), width)))
            over.append(np.zeros((len(codes[m]), width)))
            np.add.at(total[m], parent, own)
            np.add.at(kinds[m], parent, own > 0)
            if m:
                shorter = self._find(m, after & ((1 << 8 * m) - 1))  # the same symbol after the context without its first byte
                np.add.at(over[m], parent, np.where(own > 0, counts[m - 1][shorter], 0))
        log = lambda x: np.log2(np.maximum(x, 1e-300))
        start = [log(t + k) for t, k in zip(total, kinds, strict=True)]
        leave = [np.where(k > 0, s - log(k), 0.0) for s, k in zip(start, kinds, strict=True)]
        rest = np.log2(np.maximum(256 - kinds[0][0], 1))
        # by context: denominator in the next shorter context without what is seen in this one, escape from there, all escapes below
        self.suffix = [None, *(self._find(m - 1, codes[m] & ((1 << 8 * (m - 1)) - 1)) for m in range(1, order + 2))]
        self.below, self.onward, self.path = [None], [None], [np.zeros((1, width))]
        for m in range(1, order + 1):
            new = kinds[m - 1][self.suffix[m]] - kinds[m]
            self.below.append(log(total[m - 1][self.suffix[m]] - over[m] + new))
            self.onward.append(np.where(new > 0, self.below[m] - log(new), 0.0))
            self.path.append(self.onward[m] + self.path[m - 1][self.suffix[m]])
        self.down = [x + y for x, y in zip(leave, self.path, strict=True)]
        # by string: its byte below its own context, and the byte where the string's context is the longest one
        self.under, self.whole = [rest[None, :]], [rest[None, :]]
        for m in range(1, order + 2):
            context = self._find(m - 1, codes[m] >> 8) if m > 1 else np.zeros(len(codes[m]), np.int64)
            if m == 1:
                under = np.broadcast_to(rest, (len(codes[1]), width))
            else:
                shorter = self.bits[m - 1][self.suffix[m]]
                seen = shorter > -np.inf
                under = np.where(seen, self.below[m - 1][context] - np.where(seen, shorter, 0), self.onward[m - 1][context] + self.under[m - 1][self.suffix[m]])
            seen = self.bits[m] > -np.inf
            self.under.append(under if m <= order else None)  # the longest strings are whole ones only
            self.whole.append(np.where(seen, start[m - 1][context] - np.where(seen, self.bits[m], 0), leave[m - 1][context] + under))
        self.rest, self.bits[order + 1] = rest, None

    def _find(self, m: int, code: np.ndarray) -> np.ndarray:
        return self.strings[m].find(code) if m else np.zeros(len(code), np.int64)

    def _longest(self, data: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and number of the longest known string that ends at each position; ``depth``: bytes of its row up to there."""
        length, number = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        left = np.arange(len(data))
        for m in range(self.order + 1, 0, -1):
            own = left[depth[left] >= m]
            code = np.zeros(len(own), np.int64)
            for k in range(m):
                code = (code << 8) | data[own - (m - 1 - k)]
            at = self._find(m, code)
            hit = at >= 0
            length[own[hit]], number[own[hit]] = m, at[hit]
            left = left[length[left] == 0]
        return length, number

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every row in every language."""
        n, width, top = len(data), len(self.langs), self.order + 1
        out = np.zeros((len(offsets) - 1, width))
        if not n:
            return out
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        depth = np.arange(1, n + 1) - offsets[:-1][row]
        length, number = self._longest(data, depth)
        # the longest context of a position is the longest string that ends before it, but for the one byte too many
        before, context = np.zeros(n, np.int64), np.zeros(n, np.int64)
        before[1:], context[1:] = length[:-1], number[:-1]
        before[depth == 1] = context[depth == 1] = 0
        long = before == top
        context[long] = self.suffix[top][context[long]]
        before[long] = self.order
        for i in range(0, n, STEP):
            part = slice(i, i + STEP)
            m, own, k, its = length[part], number[part], before[part], context[part]
            bits = np.empty((len(m), width))
            for w in range(top + 1):
                plain = np.flatnonzero((m == w) & (k < max(w, 1)))
                bits[plain] = self.whole[w][own[plain]] if w else self.down[0] + self.rest
                for deep in range(max(w, 1), top):  # contexts that have not been followed by this byte
                    at = np.flatnonzero((m == w) & (k == deep))
                    if not len(at):
                        continue
                    way = self.down[deep][its[at]]
                    if not w:
                        bits[at] = way + self.rest
                        continue
                    shorter = its[at]
                    for step in range(deep, w, -1):
                        shorter = self.suffix[step][shorter]
                    counts = self.bits[w][own[at]]
                    seen = counts > -np.inf
                    bits[at] = way - self.path[w][shorter] + np.where(seen, self.below[w][shorter] - np.where(seen, counts, 0), self.onward[w][shorter] + self.under[w][own[at]])
            rows = row[part]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            out[rows[first]] += np.add.reduceat(bits, first, axis=0)
        return out


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(((data | 32) >= ord("a")) & ((data | 32) <= ord("z")))])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for r in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[r] = any(map(str.isalpha, data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _built(langs: list[str], order: int, folder: str):
    """Counted strings of some languages to the path of a file with their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([*batches])
        which = pc.index_in(got["lang"], pa.array(langs)).to_numpy().astype(np.int64)
        trees = Trees(langs, which, *(got[c].to_numpy() for c in ("length", "code", "n")), order)
        place, path = place_of(folder)
        place.create_dir(path, recursive=True)
        name = f"trees-{uuid.uuid4().hex}"
        with place.open_output_stream(f"{path}/{name}") as f:
            pickle.dump(trees, f, protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    return trimmed(run)


_loaded: dict[str, Trees] = {}


def _trees(path: str) -> Trees:
    """The trees of a file, which a worker holds until it is asked for others."""
    if path not in _loaded:
        _loaded.clear()
        place, at = place_of(path)
        with place.open_input_stream(at) as f:
            _loaded[path] = pickle.load(f)
    return _loaded[path]


def _scored(model: str):
    """lang_pred, bits of it and the sum of 2^(bits - own bits) over the model's languages; nulls for texts without a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(model)
        names = pa.array(trees.langs)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n = batch.num_rows
            best, bits, total, letters = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            for i, j in blocks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                letters[i:j] = _has_letter(part, own)
                lengths = trees.lengths(part, own)
                best[i:j] = lengths.argmin(axis=1)
                bits[i:j] = lengths.min(axis=1)
                total[i:j] = np.exp2(np.maximum(bits[i:j, None] - lengths, -1000)).sum(axis=1)
            kept = [x for x in batch.schema.names if x != "text"]
            found = [names.take(pa.array(best, mask=~letters)), pa.array(bits, mask=~letters), pa.array(total, mask=~letters)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *found], names=[*kept, "_best", "_bits", "_total"])

    return trimmed(run)


def learn(docs: DataFrame, p: LanguageModel) -> list[str]:
    """Paths of trees, learned from the rows that are not held out: of all languages, or of as many as are scored at once.

    A task builds them from the counted strings of a bounded sample and leaves them in the shared folder, where workers read them.
    """
    if not 0 <= p.order <= 6:
        raise ValueError("a context has 6 bytes at most")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", p.folds) != p.held_out)).select("doc_id", "lang", "text")
    sizes = cut(labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(p.train_rows) / F.count("*")).alias("share")))
    sample = labelled.join(small(sizes, sizes.count()), "lang").where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("learn")), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = cut(sample.select("lang", "text").mapInArrow(_counted(p), "lang string, length int, code long, n long").groupBy("lang", "length", "code").agg(F.sum("n").alias("n")))
    groups: list[list[str]] = []
    room = 0
    for lang, n in sorted((r["lang"], r["count"]) for r in counts.groupBy("lang").count().collect()):  # one row a language
        if not groups or n > room:
            groups.append([])
            room = p.strings
        groups[-1].append(lang)
        room -= n
    folder, models = shared_path(docs.sparkSession, "languages"), []
    for langs in groups:
        models.append(counts.where(F.col("lang").isin(langs)).coalesce(1).mapInArrow(_built(langs, p.order, folder), "path string").first()["path"])
    return models


def predict(docs: DataFrame, models: list[str], *, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, lang_pred and score (the posterior share of the best language)."""
    rows = docs.select(*keep, "text")
    new = [T.StructField("_best", T.StringType()), T.StructField("_bits", T.DoubleType()), T.StructField("_total", T.DoubleType())]
    pred, score = F.coalesce("_best", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / F.col("_total"), F.lit(0.0)).alias("score")
    if not models:
        return rows.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(models) == 1:
        return rows.mapInArrow(_scored(models[0]), T.StructType([*rows.schema.fields[:-1], *new])).select(*keep, pred, score)
    # a pass for each group of languages; what they say of a row meets by its number
    keyed = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    said = reduce(DataFrame.union, (keyed.select("_row", "text").mapInArrow(_scored(m), T.StructType([T.StructField("_row", T.LongType()), *new])) for m in models))
    said = cut(said.where("_best is not null"))
    least = said.groupBy("_row").agg(F.min(F.struct("_bits", "_best")).alias("m")).select("_row", "m.*")
    total = said.select("_row", F.col("_bits").alias("b"), "_total").join(least, "_row").groupBy("_row").agg(F.first("_best").alias("_best"), F.sum(F.expr("_total * pow(2d, greatest(-1000d, _bits - b))")).alias("_total"))
    return keyed.drop("text").join(total, "_row", "left").select(*keep, pred, score)


def identify(docs: DataFrame, p: LanguageModel = LanguageModel()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    Learns only from rows with text and lang whose crc32 of doc_id modulo ``folds`` is not ``held_out``. A text that is
    null, empty or without a letter, or any text when nothing could be learned, is ``und`` with score 0. Equal texts
    get equal predictions; of equal code lengths the alphabetically first language wins. A null doc_id is held out as
    false and not learned from. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    rows = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", p.folds) == p.held_out, F.lit(False)))
    return predict(rows, learn(docs, p), keep=["doc_id", "held_out"])


def spoken(docs: DataFrame, p: LanguageModel = LanguageModel(), least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text has a language, with a posterior share of ``least`` or more; all columns as they are."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_hash"))
    found = predict(rows, learn(rows, p), keep=["doc_id", "text_hash"])
    return without(docs, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)))
