"""Quality rules over documents and over lines that the documents of a host share, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, folded, small, unfolded


@dataclass(frozen=True)
class QualityRules:
    """A line is removed if more than ``most_docs`` documents of its host have it, whatever the host's size is. A document
    that has less than ``left`` of its lines' characters then is rejected. With ``by_text`` equal texts of a host
    count as one document, so copies do not deplete each other. ``words`` is the least number of words; at most ``repeats``
    percent may be in repeated windows of ``window`` words.
    """

    words: int = 10
    window: int = 5
    repeats: int = 20
    most_docs: int = 10
    left: float = 0.3
    by_text: bool = False


_BLANK = " \t\n\x0b\f\r"
_BLANKS = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for a row."""
    return F.transform(F.array(value), use)[0]


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(_BLANK))), _BLANKS, " ")


def _repeated(hashes: Column, window: int) -> Column:
    """Words in windows that occur more than once, from the windows' hashes in order."""

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda x, y: F.least(y - x, F.lit(window)))
        return F.aggregate(steps, F.lit(window), lambda a, x: a + x)

    def doubled(s: Column) -> Column:
        same = lambda x, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == x["h"])
        return _let(F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])), covered)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, doubled))


def _measured(docs: DataFrame, p: QualityRules) -> DataFrame:
    """A row's counts, and the hashes and lengths of its normalised lines."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("host"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANK))
    rows = rows.withColumns({
        "w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS)),
        "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != ""),
    })
    part = lambda c, first, less: F.slice(c, F.lit(first), F.greatest(F.size("w") - less, F.lit(0)))
    join = lambda x, y: F.xxhash64(x, y)
    rows = rows.select(
        "doc_id", "host", "w",
        F.xxhash64("text", F.lit("text")).alias("text_hash"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.length(x).alias("chars"))).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    rows = rows.withColumn("two", F.zip_with(part("h", 1, 1), part("h", 2, 1), join))
    rows = rows.withColumn("four", F.zip_with(part("two", 1, 3), part("two", 3, 3), join))
    rows = rows.withColumn("five", F.zip_with(part("four", 1, 4), part("h", 5, 4), join))
    return rows.select(
        "doc_id", "host", "text_hash", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", _repeated(F.col("five"), p.window).cast("long").alias("n_repeat_words"), "lines",
    )


def _judged(docs: DataFrame, p: QualityRules) -> DataFrame:
    """The counts of every row and its verdict, with its text's hash, its host and the hashes of its lines that are removed."""
    if p.window != 5:
        raise ValueError("windows have five words")
    base = cut(_measured(docs, p).withColumn("row", F.monotonically_increasing_id()))
    lines = F.array_distinct(F.transform("lines", lambda x: x["line"]))
    counted = base
    if p.by_text:
        counted = base.join(base.groupBy("host", "text_hash").agg(F.min("row").alias("row")).select("row"), "row", "left_semi")
    common = counted.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > p.most_docs).select("host", "line")
    common = cut(common)
    gone = base.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.chars").join(small(common, common.count()), ["host", "line"])
    removed = gone.groupBy("row").agg(F.sum("chars").alias("removed"), F.collect_set("line").alias("gone"))
    failed = (F.col("n_words") < p.words) | (100 * F.col("n_repeat_words") > p.repeats * F.col("n_words"))
    total = F.aggregate(F.transform("lines", lambda x: x["chars"]), F.lit(0).cast("long"), lambda a, x: a + x)
    lost = F.coalesce("removed", F.lit(0)).cast("long")
    out = base.join(removed, "row", "left").withColumns({"base_failed": failed, "n_chars_removed": lost})
    return out.withColumn("kept", ~failed & (total - lost >= p.left * total)).drop("lines", "removed", "row")


def quality(docs: DataFrame, p: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_chars_removed of every row.

    ``docs`` has doc_id, text and source, which is the host; other columns are ignored. A null text is an empty one, which
    fails for want of words; a null source is a host of its own. Lines are compared in lower case with
    white space made one blank. Every row counts once for each of its lines, repeated rows too; they are judged
    each. n_repeat_words is for windows of five words. An empty table gives an empty table.
    """
    return _judged(docs, p).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_chars_removed")


def cleaned(docs: DataFrame, p: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the lines that are removed; all columns as they are."""
    keys = lambda of: [F.col("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), F.xxhash64(F.coalesce("text", F.lit("")), F.lit("text"))] if of else [F.col("its_id"), F.col("its_host"), F.col("its_hash")]
    told = _judged(docs, p).where("not kept or gone is not null").select(F.col("doc_id").alias("its_id"), F.col("host").alias("its_host"), F.col("text_hash").alias("its_hash"), "kept", "gone").dropDuplicates(["its_id", "its_host", "its_hash"])
    told = cut(told)
    rows = folded(docs, "doc_id", "source", "text")
    same = reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(keys(True), keys(False), strict=True)))
    met = rows.join(small(told, told.count(), 100_000), same, "left").where("kept is null or kept")
    stays = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(_normal(x))) | (F.btrim(x, F.lit(_BLANK)) == "")), "\n")
    return unfolded(met.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(stays)), docs, "doc_id", "source", "text")
