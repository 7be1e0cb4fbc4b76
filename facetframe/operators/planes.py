"""Plane fits of point groups and joins between planes."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import graph


def _moments(xyz: tuple[str, str, str], weight: Column | None = None) -> list[Column]:
    x, y, z = (F.col(c) for c in xyz)
    cov = F.covar_pop
    return [F.count("*").alias("num_points"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), cov(x, x).alias("xx"), cov(y, y).alias("yy"), cov(z, z).alias("zz"), cov(x, y).alias("xy"), cov(x, z).alias("xz"), cov(y, z).alias("yz")]


def fit(points: DataFrame, keys: list[str], xyz: tuple[str, str, str] = ("x", "y", "z"), least: int = 3) -> DataFrame:
    """Least-squares plane of each group: keys, num_points, centroid, unit normal (a, b, c), d with a·x+b·y+c·z+d = 0, rms.

    The covariance is a mergeable aggregate, so a group of any size is combined before the shuffle and never gathered; the
    normal is the eigenvector of its smallest eigenvalue in closed form. The sign makes d >= 0. Groups of fewer than
    ``least`` points, or whose points are all on a line, are left out.
    """
    m = points.groupBy(*keys).agg(*_moments(xyz)).where(F.col("num_points") >= least)
    xx, yy, zz, xy, xz, yz = (F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz"))
    q = (xx + yy + zz) / 3
    p = F.sqrt(F.greatest(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6, F.lit(1e-300)))
    m = m.withColumns({"q": q, "p": p})
    q, p = F.col("q"), F.col("p")
    b = {k: (c - q if k in ("xx", "yy", "zz") else c) / p for k, c in (("xx", xx), ("yy", yy), ("zz", zz), ("xy", xy), ("xz", xz), ("yz", yz))}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    third = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    m = m.withColumn("low", q + 2 * p * F.cos(third + 2.0943951023931953))
    low = F.col("low")
    rows = [[xx - low, xy, xz], [xy, yy - low, yz], [xz, yz, zz - low]]
    crosses = [G.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    for k, c in enumerate(crosses):
        m = m.withColumn(f"v{k}", F.struct(G.dot(c, c).alias("size"), F.lit(k).alias("k"), *[x.alias(n) for x, n in zip(c, "abc", strict=True)]))
    # exploding a filtered array of one keeps the condition here: as a filter it would be moved below all this, inlined
    m = m.withColumn("v", F.greatest("v0", "v1", "v2"))
    m = m.select(*keys, "num_points", "mx", "my", "mz", "low", F.explode(F.filter(F.array("v"), lambda v: v["size"] > 1e-22 * F.pow(F.col("q"), F.lit(4.0)))).alias("v"))
    n = [F.col(f"v.{c}") / F.sqrt("v.size") for c in "abc"]
    d = -(n[0] * F.col("mx") + n[1] * F.col("my") + n[2] * F.col("mz"))
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    return m.select(*keys, "num_points", "mx", "my", "mz", *[(x * sign).alias(c) for x, c in zip(n, "abc", strict=True)], (d * sign).alias("d"), F.sqrt(F.greatest(low, F.lit(0.0))).alias("rms"))


def residual() -> Column:
    return F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))


def inlier_table(points: DataFrame, planes: DataFrame, keys: list[str], threshold: float, support: int = 0) -> DataFrame:
    """Planes with their inliers and inlier share, those of fewer than ``support`` inliers left out."""
    near = points.join(planes.select(*keys, "a", "b", "c", "d"), keys).groupBy(*keys).agg(F.count("*").alias("points"), F.count_if(residual() < threshold).alias("refined_inliers"))
    return near.where(F.col("refined_inliers") >= support).withColumn("inlier_ratio_refined", F.col("refined_inliers") / F.col("points"))


def split_by_ratio(planes: DataFrame, ratio: float) -> DataFrame:
    """Planes below the inlier share are flagged and their counters zeroed."""
    low = F.col("inlier_ratio_refined") < ratio
    return planes.withColumns({"is_outlier": low, "refined_inliers": F.when(low, 0).otherwise(F.col("refined_inliers")), "inlier_ratio_refined": F.when(low, 0.0).otherwise(F.col("inlier_ratio_refined"))})


def distance_quantiles(points: DataFrame, planes: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles of the point-to-plane distance of each group, interpolated linearly."""
    return points.join(planes.select(*keys, "a", "b", "c", "d"), keys).groupBy(*keys).agg(*[F.percentile(residual(), F.lit(q)).alias(n) for n, q in shares.items()])


#: Planes of a group that are one row, an array; a task holds the pairs of two such rows at once.
BLOCK = 256


def _sound(planes: DataFrame, plane_id: str, normal: list[str], keys: list[str]) -> DataFrame:
    """keys, id, x, y, z and d of the planes that can agree with any: those of null or non-finite numbers agree with none."""
    rows = planes.select(*keys, F.col(plane_id).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip([*normal, "d"], "xyzd", strict=True)])
    whole = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyzd"]
    return rows.where(whole[0] & whole[1] & whole[2] & whole[3])


def _grouped(rows: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Groups of planes with one normal and offsets in one cell of ``step``: gid, their number, least id and range of offsets."""
    groups = rows.groupBy(*keys, "x", "y", "z", F.floor(F.col("d") / step).alias("cell")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    return graph.written(groups.withColumn("gid", F.monotonically_increasing_id()))


def _met(groups: DataFrame, keys: list[str], degrees: float, distance: float, opposite: bool = False) -> DataFrame:
    """Pairs (p <= q, by gid; a group meets itself) of groups with normals that agree and offsets that can: keys, pgid, qgid, pn, qn, pfirst, qfirst, dots.

    Unit normals within the angle are a chord apart at most, so groups meet in cells of that width, and of ``distance`` for offsets.
    ``opposite``: normals may also be opposite, and offsets then of opposite sign.
    """
    chord = 2 * sin(radians(min(degrees, 180.0)) / 2) + 1e-9
    carried = ["gid", "n", "first", "x", "y", "z"]
    left = groups.select(*keys, *[F.col(c).alias(f"p{c}") for c in carried], F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.lit(1).alias("turn"))
    if opposite:
        left = left.union(left.select(*keys, "pgid", "pn", "pfirst", *[-F.col(f"p{c}") for c in "xyz"], -F.col("phi"), -F.col("plo"), F.lit(-1)))
    spot = lambda side: [F.floor(F.col(f"{side}{c}") / chord) for c in "xyz"] + [F.floor(F.col(f"{side}lo") / distance)]
    steps = F.array(*[F.struct(*[F.lit(s).alias(n) for s, n in zip((i, j, k, m), "xyzd", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) for m in (-2, -1, 0, 1, 2)])
    left = left.select("*", F.explode(steps).alias("s")).select("*", *[(c + F.col(f"s.{n}")).alias(f"g{n}") for c, n in zip(spot("p"), "xyzd", strict=True)]).drop("s")
    right = groups.select(*keys, *[F.col(c).alias(f"q{c}") for c in carried], F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    right = right.select("*", *[c.alias(f"g{n}") for c, n in zip(spot("q"), "xyzd", strict=True)])
    met = left.hint("merge").join(right, [*keys, "gx", "gy", "gz", "gd"]).where("pgid <= qgid")
    dots = F.col("px") * F.col("qx") + F.col("py") * F.col("qy") + F.col("pz") * F.col("qz")
    met = met.withColumn("dots", dots).where((F.col("dots") >= cos(radians(degrees))) & (F.greatest(F.col("qlo") - F.col("phi"), F.col("plo") - F.col("qhi")) <= distance))
    if opposite:
        met = met.where("dots > 0 or turn = 1 and dots = 0")
    return met.select(*keys, "pgid", "qgid", "pn", "qn", "pfirst", "qfirst", (F.col("turn") * F.col("dots")).alias("dots"))


def agreeing(planes: DataFrame, keys: list[str], degrees: float, distance: float, plane_id: str, normal: list[str], opposite: bool = False) -> DataFrame:
    """Pairs (keys, a < b, dots, ad, bd) of planes with unit normals within ``degrees`` and offsets that may be within ``distance``.

    Planes of one normal and one cell of offsets are a group; the groups that agree are paired first, so planes of unlike normals never
    meet. A large group is dealt to blocks of ``BLOCK``, so a task holds as many planes and not a group. Blocks meet as arrays: what is
    shuffled and sorted is a row for two blocks, and their pairs are made where they end.
    """
    rows = _sound(planes, plane_id, normal, keys)
    groups = _grouped(rows, keys, distance)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    key = [*keys, "x", "y", "z", "cell"]
    members = rows.withColumn("cell", F.floor(F.col("d") / distance)).hint("merge").join(groups.select(*key, "gid", "n"), key).select("gid", F.pmod(F.xxhash64("id"), blocks("n")).cast("int").alias("blk"), F.struct("id", "d").alias("plane"))
    members = members.groupBy("gid", "blk").agg(F.collect_list("plane").alias("of"))
    met = _met(groups, keys, degrees, distance, opposite)
    met = met.withColumn("pblk", F.explode(F.sequence(F.lit(0), blocks("pn") - 1))).withColumn("qblk", F.explode(F.sequence(F.lit(0), blocks("qn") - 1))).where("pgid < qgid or pblk <= qblk")
    side = lambda k: members.select(*[F.col(c).alias(f"{k}{c}") for c in ("gid", "blk", "of")])
    place = ["pgid", "pblk", "qgid", "qblk"]
    both = met.select(*keys, *place, "dots").hint("merge").join(side("p"), ["pgid", "pblk"]).hint("merge").join(side("q"), ["qgid", "qblk"])
    pairs = both.select(*keys, *place, "dots", "qof", F.explode("pof").alias("p")).select(*keys, *place, "dots", "p", F.explode("qof").alias("q"))
    pairs = pairs.select(*keys, *place, "dots", *[F.col(f"{k}.{c}").alias(f"{k}{c}") for k in "pq" for c in ("id", "d")])
    pairs = pairs.where("pid <> qid and (pgid < qgid or pblk < qblk or pid < qid)")
    first = F.col("pid") < F.col("qid")
    return pairs.select(*keys, F.least("pid", "qid").alias("a"), F.greatest("pid", "qid").alias("b"), "dots", F.when(first, F.col("pd")).otherwise(F.col("qd")).alias("ad"), F.when(first, F.col("qd")).otherwise(F.col("pd")).alias("bd"))


def coplanar_pairs(planes: DataFrame, degrees: float, distance: float, within: list[str] | None = None) -> DataFrame:
    """Pairs (a < b) of planes whose normals are within ``degrees`` and whose offsets are within ``distance``: every pair, once."""
    within = within or []
    offset = F.abs(F.col("ad") - F.col("bd"))
    met = agreeing(planes, within, degrees, distance, "plane_id", ["nx", "ny", "nz"]).where(offset <= distance)
    return met.select(*within, F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("dots").alias("cosine"), offset.alias("offset"))


def facing_pairs(planes: DataFrame, degrees: float, distance: float, within: list[str]) -> DataFrame:
    """As ``coplanar_pairs``, but opposite normals agree too: their offsets then count with opposite signs."""
    gap = signed_offset(F.col("dots"), F.col("ad"), F.col("bd"))
    met = agreeing(planes, within, degrees, distance, "plane_id", ["nx", "ny", "nz"], True).where(gap <= distance)
    return met.select(*within, F.col("a").alias("a_id"), F.col("b").alias("b_id"), gap.alias("gap"))


def coplanar_totals(planes: DataFrame, degrees: float, distance: float) -> DataFrame:
    """Number of the ``coplanar_pairs`` and sum of their offsets, without the pairs: planes of one normal and one offset are counted once and weighted."""
    rows = _sound(planes, "plane_id", ["nx", "ny", "nz"], [])
    groups = _grouped(rows, [], distance)
    key = ["x", "y", "z", "cell"]
    members = rows.withColumn("cell", F.floor(F.col("d") / distance)).groupBy(*key, "d").agg(F.count("*").alias("w")).hint("merge").join(groups.select(*key, "gid"), key)
    side = lambda k: members.select(*[F.col(c).alias(f"{k}{c}") for c in ("gid", "d", "w")])
    offset = F.abs(F.col("pd") - F.col("qd"))
    met = _met(groups, [], degrees, distance).select("pgid", "qgid").hint("merge").join(side("p"), "pgid").hint("merge").join(side("q"), "qgid").where((offset <= distance) & ((F.col("pgid") < F.col("qgid")) | (F.col("pd") <= F.col("qd"))))
    times = F.when((F.col("pgid") == F.col("qgid")) & (F.col("pd") == F.col("qd")), F.expr("pw * (pw - 1) div 2")).otherwise(F.col("pw") * F.col("qw"))
    counted = met.agg(F.sum(times).alias("pairs"), F.sum(times * offset).alias("total"))
    # rows of one id are no pair
    again = rows.join(rows.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi").withColumn("row", F.monotonically_increasing_id())
    of = lambda k: again.select("id", *[F.col(c).alias(f"{k}{c}") for c in ("row", *"xyzd")])
    dots = F.col("px") * F.col("qx") + F.col("py") * F.col("qy") + F.col("pz") * F.col("qz")
    same = of("p").join(of("q"), "id").where((F.col("prow") < F.col("qrow")) & (dots >= cos(radians(degrees))) & (offset <= distance)).agg(F.count("*").alias("less"), F.coalesce(F.sum(offset), F.lit(0.0)).alias("off"))
    left = F.coalesce("pairs", F.lit(0)) - F.col("less")
    return counted.crossJoin(same).select(left.alias("pairs"), F.when(left > 0, F.col("total") - F.col("off")).alias("total"))


def coplanar_components(planes: DataFrame, degrees: float, distance: float, within: list[str]) -> DataFrame:
    """Component (its smallest plane_id) of every plane under ``coplanar_pairs``, without the pairs.

    Offsets of one normal that follow each other within ``distance`` are a chain; two chains of normals that agree have a link if their
    ranges overlap or come as near as that. Links are those of chains and a star of each chain's planes.
    """
    rows = _sound(planes, "plane_id", ["nx", "ny", "nz"], within).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") >= cos(radians(degrees)))
    normal, half = [*within, "x", "y", "z"], F.floor(F.col("d") / (distance / 2))
    cells = rows.groupBy(*normal, half.alias("cell")).agg(F.min("id").alias("first"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    w = Window.partitionBy(*normal).orderBy("cell")
    opened = F.coalesce((F.col("lo") - F.lag("hi").over(w) > distance).cast("int"), F.lit(0))
    cells = graph.written(cells.withColumn("_open", opened).withColumn("chain", F.sum("_open").over(w)).withColumn("head", F.min("first").over(Window.partitionBy(*normal, "chain"))).drop("_open"))
    chains = cells.groupBy(*normal, "chain").agg(F.min("head").alias("head"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    chord = 2 * sin(radians(min(degrees, 180.0)) / 2) + 1e-9
    spot = [F.floor(F.col(c) / chord) for c in "xyz"]
    at = lambda c: F.floor(F.col(c) / distance)
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"s{n}") for s, n in zip((i, j, k), "xyz", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    side = lambda k: [F.col(c).alias(f"{k}{c}") for c in ("head", "x", "y", "z", "lo", "hi")]
    left = chains.select("*", F.explode(steps).alias("s")).select(*within, *side("p"), *[(c + F.col(f"s.s{n}")).alias(f"g{n}") for c, n in zip(spot, "xyz", strict=True)], F.explode(F.sequence(at("lo") - 2, at("hi") + 2)).alias("gd"))
    right = chains.select(*within, *side("q"), *[c.alias(f"g{n}") for c, n in zip(spot, "xyz", strict=True)], F.explode(F.array_distinct(F.array(at("lo"), at("hi")))).alias("gd"))
    # of two chains that are near each other, one begins inside the other's range or the two ends that face each other do
    dots = F.col("px") * F.col("qx") + F.col("py") * F.col("qy") + F.col("pz") * F.col("qz")
    near = F.greatest(F.col("qlo") - F.col("phi"), F.col("plo") - F.col("qhi")) <= distance
    links = left.hint("merge").join(right, [*within, "gx", "gy", "gz", "gd"]).where((F.col("phead") != F.col("qhead")) & (dots >= cos(radians(degrees))) & near).select(*within, F.col("phead").alias("a"), F.col("qhead").alias("b"))
    stars = rows.withColumn("cell", half).hint("merge").join(cells.select(*normal, "cell", "head"), [*normal, "cell"]).select(*within, F.col("head").alias("a"), F.col("id").alias("b"))
    return graph.components(planes.select(*within, "plane_id"), links.union(stars), within, "plane_id", "a", "b")


def signed_offset(dots: Column, a: Column, b: Column) -> Column:
    """Offset between two planes whose normals may point in opposite directions."""
    return F.when(dots < 0, F.abs(a + b)).otherwise(F.abs(a - b))


def gap_clusters(rows: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Numbers the runs of ``value`` in each group that gaps of more than ``gap`` part (a session window in space)."""
    w = Window.partitionBy(*keys).orderBy(value)
    opened = rows.withColumn("_open", F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0))
    return opened.withColumn("cluster", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")
