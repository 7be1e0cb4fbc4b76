"""Temperature mixing of sources, in DataFrame operations only.

A source's weight is its share of the tokens raised to an exponent between 0 (all equal) and 1 (as they are) and
normalised. Two bisections find the exponent. The weights are realised over blocks of each source: every pass is a
permutation of its blocks, and the last pass ends where the budget does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, folded, small, unfolded


@dataclass(frozen=True)
class Mixture:
    """The exponent is the largest that reaches ``entropy`` of the sources' greatest entropy, or, if that repeats a source
    more than ``repeats`` times, the smallest that does not. ``budget`` is in tokens: a source gets its weight of it, repeated or
    cut down to whole blocks. Without one it is the least that takes every source whole, so
    weights are met by repeating and no row is dropped. Tokens are estimated as ``bytes_per_token``. A source has a
    block for each ``block_tokens``, ``blocks`` at least; ``bins`` of a permutation are ordered apart.
    """

    entropy: float = 0.99
    repeats: float = 2.0
    bytes_per_token: int = 4
    block_tokens: int = 1_000_000
    blocks: int = 64
    seed: int = 5
    budget: float | None = None
    bins: int = 1024
    steps: int = 50


def _bisected(shares: str, p: Mixture) -> str:
    """SQL of the exponent for an array of token counts."""
    entropy = """ln(aggregate({t}, 0d, (z, x) -> z + pow(x, {m}))) - {m} * aggregate({t}, 0d, (z, x) -> z + pow(x, {m}) * ln(x))
        / aggregate({t}, 0d, (z, x) -> z + pow(x, {m}))"""
    target = f"{p.entropy}d * ln(size({shares}))"
    middle = "((b.lo + b.hi) / 2)"

    def search(good: str, keep_low: bool) -> str:
        low, high = f"named_struct('lo', {middle}, 'hi', b.hi)", f"named_struct('lo', b.lo, 'hi', {middle})"
        step = f"if({good}, {low}, {high})" if keep_low else f"if({good}, {high}, {low})"
        return f"aggregate(sequence(1, {p.steps}), named_struct('lo', 0d, 'hi', 1d), (b, i) -> {step}).{'lo' if keep_low else 'hi'}"

    spread = f"(array_max({shares}) / array_min({shares}))"
    flat = f"if({entropy.format(t=shares, m='1d')} >= {target}, 1d, {search(entropy.format(t=shares, m=middle) + ' >= ' + target, True)})"
    limit = f"if({spread} <= {p.repeats}d, 0d, {search(f'pow({spread}, 1 - {middle}) <= {p.repeats}d', False)})"
    return f"round(greatest({flat}, {limit}), 9)"


def _hashed(*parts: str) -> str:
    return f"cast(conv(substr(md5(cast(concat_ws(':', {', '.join(parts)}) as binary)), 1, 8), 16, 10) as bigint)"


def plan(docs: DataFrame, p: Mixture = Mixture()) -> tuple[DataFrame, DataFrame]:
    """``docs`` with mix_source, mix_tokens and mix_block, and the table of the blocks to take by pass."""
    rows = docs.withColumns({"mix_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), "mix_tokens": F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / p.bytes_per_token))})
    sources = rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"))
    # one row for each source: their number is the only thing that is gathered
    exponent = sources.agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t")).select(F.expr(_bisected("t", p)).alias("exponent"), "t")
    weights = sources.crossJoin(F.broadcast(exponent)).selectExpr("mix_source", "tokens", "exponent", "pow(tokens, exponent) / aggregate(t, 0d, (z, x) -> z + pow(x, exponent)) as weight", "aggregate(t, 0d, (z, x) -> greatest(z, pow(x, 1 - exponent))) as most")
    # the budget over a source's own tokens; the least one is tokens^(exponent - 1) times the largest tokens^(1 - exponent)
    repetition = "greatest(1d, most * pow(tokens, exponent - 1))" if p.budget is None else f"{p.budget}d * weight / tokens"
    sized = cut(weights.selectExpr("mix_source", "tokens", "exponent", "round(weight, 9) as weight", f"round({repetition}, 9) as repetition", f"greatest({p.blocks}L, ceil(tokens / {p.block_tokens})) as blocks"))
    rows = rows.join(small(sized.select("mix_source", "blocks", "weight", "repetition"), sized.count()), "mix_source").withColumn("mix_block", F.expr(f"pmod({_hashed(str(p.seed), 'doc_id')}, blocks)")).drop("blocks")
    blocks = rows.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens")).join(sized, "mix_source")
    passes = blocks.withColumn("pass", F.explode(F.expr("sequence(0, greatest(1, cast(ceil(repetition) as int)) - 1)")))
    passes = passes.withColumn("order", F.expr(_hashed(str(p.seed), "mix_source", "pass", "mix_block")))
    # a permutation is ordered by a hash: bins of it are ordered each in a task, behind the sums of those before
    passes = passes.withColumn("bin", F.expr(f"order div {(1 << 32) // p.bins}"))
    sums = passes.groupBy("mix_source", "pass", "bin").agg(F.count("*").alias("n"), F.sum("block_tokens").alias("t"))
    before = Window.partitionBy("mix_source", "pass").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("mix_source", "pass", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"))
    turn = Window.partitionBy("mix_source", "pass", "bin").orderBy("order", "mix_block")
    passes = passes.withColumns({"rank": F.row_number().over(turn) - 1, "upto": F.sum("block_tokens").over(turn)}).join(sums, ["mix_source", "pass", "bin"])
    passes = passes.withColumns({"rank": F.col("rank") + F.col("n_before"), "upto": F.col("upto") + F.col("t_before")})
    taken = passes.where("upto - block_tokens / 2.0d <= tokens * least(1d, repetition - pass)")
    return rows, cut(taken.select("mix_source", "mix_block", "pass", "rank"))


def mixed(docs: DataFrame, p: Mixture = Mixture()) -> DataFrame:
    """doc_id, source, tokens, weight (of the source), repetition, pass, block and block_rank of every row taken.

    ``docs`` has doc_id, source and text; other columns are ignored. Every row of ``docs`` is taken in pass 0 and, as its
    source's repetition and the permutation of its block decide, once more in later passes; with a smaller ``budget`` only as
    many blocks of pass 0 as it asks for. A row's block is
    a hash of its doc_id, so repeated rows stay together. A null source is a source of its own; a null or empty text
    counts one token. Blocks that hash alike are in the order of their numbers. An empty table gives an empty table.
    """
    rows, taken = plan(docs.select("doc_id", "source", "text"), p)
    rows = rows.selectExpr("doc_id", "source", "mix_tokens as tokens", "weight", "repetition", "mix_source", "mix_block")
    return rows.join(small(taken, taken.count()), ["mix_source", "mix_block"]).selectExpr("doc_id", "source", "tokens", "weight", "repetition", "pass", "mix_block as block", "cast(rank as bigint) as block_rank")


def repeated(docs: DataFrame, p: Mixture = Mixture()) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each as often as it does; all columns as they are."""
    rows, taken = plan(folded(docs, "doc_id", "source", "text"), p)
    return unfolded(rows.join(small(taken, taken.count()), ["mix_source", "mix_block"]), docs, "doc_id", "source", "text")
