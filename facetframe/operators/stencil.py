"""Neighbourhood operators on pixel rasters.

The relational forms take a table of pixels (scene_id, frame_id, v, u, ...). Each pixel is replicated to the rows where it is a
neighbour and met there in its column, and a window over the row does the rest; where frames are whole in a task, nothing is shuffled.
"""

from __future__ import annotations

from math import cos, radians, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

PIXEL = ["scene_id", "frame_id", "v", "u"]
FRAME = PIXEL[:2]


def _columns(px: DataFrame, reach: int, sums: list[Column], kept: list[str]) -> DataFrame:
    """``sums`` over the pixels at most ``reach`` rows away in a pixel's column (``dv`` is how far below it they are), at all places that see one.

    Each pixel is replicated to the rows where it is a neighbour; one that is there itself gives its columns ``kept`` to the struct ``own``.
    """
    steps = F.array(*[F.lit(dv) for dv in range(-reach, reach + 1)])
    near = px.select("*", F.explode(steps).alias("dv")).withColumn("v", F.col("v") - F.col("dv"))
    here = [F.first(F.when(F.col("dv") == 0, F.col(c)), ignorenulls=True).alias(c) for c in kept]
    return near.groupBy(*PIXEL).agg(F.max(F.col("dv") == 0).alias("own"), *here, *sums)


def _beside(column: Column | str, du: int) -> Column:
    """The value at the place ``du`` to the right in the row; null where there is none."""
    return F.first(column).over(Window.partitionBy(*FRAME, "v").orderBy("u").rangeBetween(du, du))


SOBEL = [(dv, du, du * (2 - abs(dv)), dv * (2 - abs(du))) for dv in (-1, 0, 1) for du in (-1, 0, 1) if dv or du]


def normal_gradient(px: DataFrame) -> DataFrame:
    """Size of the Sobel gradient of the normals of every pixel; outside the frame they are zero.

    A Sobel gradient is a sum over the rows and then one over the columns, so three rows go out for each pixel and not eight.
    """
    normal = ("nx", "ny", "nz")
    weights = {"mean": 2 - F.abs("dv"), "step": F.col("dv")}
    sums = _columns(px, 1, [F.sum(w * F.col(c)).alias(f"{k}_{c}") for k, w in weights.items() for c in normal], [c for c in px.columns if c not in PIXEL])
    at = lambda c, du: F.coalesce(_beside(c, du), F.lit(0.0))
    across = [at(f"mean_{c}", 1) - at(f"mean_{c}", -1) for c in normal]
    down = [at(f"step_{c}", -1) + 2 * F.coalesce(f"step_{c}", F.lit(0.0)) + at(f"step_{c}", 1) for c in normal]
    wide = sums.withColumns({f"_{k}": c for k, c in enumerate(across + down)})
    square = sum((F.col(f"_{k}") * F.col(f"_{k}") for k in range(6)), F.lit(0.0))
    return wide.where("own").select(*px.columns, F.sqrt(square).alias("gradient"))


def similar(degrees: float) -> Column:
    return F.col("gradient") <= sqrt(2 - 2 * cos(radians(degrees)))


AROUND = [(dv, du, 0.0, 0.0) for dv in range(-2, 3) for du in range(-2, 3) if dv or du]


def connected_by_join(px: DataFrame, degrees: float = 5.0, relative: float = 0.025, least: int = 8, planarity: float = 0.3) -> DataFrame:
    """``connected`` in relational form: five rows for each pixel meet in its column, the results in its row.

    A row of pixels is not held at once, nor is a frame.
    """
    flat = normal_gradient(px).withColumns({"mask": F.col("planarity") > planarity, "good": F.when((F.col("planarity") > planarity) & similar(degrees), F.col("z"))})
    kept = ["z", "mask", "gradient"]
    deep = _columns(flat.select(*PIXEL, *kept, "good"), 2, [F.max(F.when(F.col("dv") == dv, F.col("good"))).alias(f"good{dv + 2}") for dv in range(-2, 3)], kept)
    each = deep.withColumn("column", F.array(*[f"good{k}" for k in range(5)])).withColumns({f"at{du + 2}": F.col("column") if du == 0 else _beside("column", du) for du in range(-2, 3)})
    near = [F.get(f"at{du + 2}", F.lit(dv + 2)) for dv, du, *_ in AROUND]
    count = sum((F.coalesce((F.abs(F.col("z") - n) < relative * F.col("z")).cast("int"), F.lit(0)) for n in near), F.lit(0))
    counted = each.where("own").withColumn("neighbours", F.when(F.col("mask"), count).otherwise(0).cast("bigint"))
    return counted.select(*PIXEL, "gradient", "neighbours").withColumn("connected", F.col("neighbours") >= least)


def _raster(rows: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row and column of each pixel from the frame's corner, and zero-filled planes of the columns with two pixels of margin."""
    v, u = rows.column("v").to_numpy(), rows.column("u").to_numpy()
    v, u = v - v.min() + 2, u - u.min() + 2
    out = []
    for c in columns:
        plane = np.zeros((v.max() + 3, u.max() + 3))
        plane[v, u] = rows.column(c).to_numpy()
        out.append(plane)
    return v, u, out


def _moved_by(plane: np.ndarray, dv: int, du: int) -> np.ndarray:
    """The plane seen at an offset, without its margin."""
    h, w = plane.shape
    return plane[2 + dv : h - 2 + dv, 2 + du : w - 2 + du]


def connected(px: DataFrame, degrees: float = 5.0, relative: float = 0.025, least: int = 8, planarity: float = 0.3) -> DataFrame:
    """Pixels with the gradient of their normals and whether ``least`` of their 24 neighbours are planar, smooth and close in depth.

    Every pixel is shuffled once, to its frame; a frame is held as small dense planes and its stencils are shifted sums.
    """
    ship(px.sparkSession)
    limit = sqrt(2 - 2 * cos(radians(degrees)))

    def frame(rows: pa.Table) -> pa.Table:
        v, u, (nx, ny, nz, z, mask) = _raster(rows, ["nx", "ny", "nz", "z", "planarity"])
        square = 0.0
        for n in (nx, ny, nz):
            for weight in (2, 3):
                square = square + sum(o[weight] * _moved_by(n, o[0], o[1]) for o in SOBEL) ** 2
        gradient = np.sqrt(square)
        on = mask > planarity
        good = np.pad(gradient <= limit, 2) & on
        centre = _moved_by(z, 0, 0)
        count = sum((_moved_by(good, dv, du) & (np.abs(centre - _moved_by(z, dv, du)) < relative * centre)).astype(np.int32) for dv, du, *_ in AROUND) * _moved_by(on, 0, 0)
        at = (v - 2, u - 2)
        n = count[at]
        return pa.table([rows.column(c) for c in PIXEL] + [pa.array(gradient[at]), pa.array(n.astype(np.int32)), pa.array(n >= least)], names=[*PIXEL, "gradient", "neighbours", "connected"])

    kinds = dict(px.dtypes)
    return px.select(*PIXEL, "nx", "ny", "nz", "z", "planarity").groupBy(*FRAME).applyInArrow(frame, ", ".join(f"{c} {kinds[c]}" for c in PIXEL) + ", gradient double, neighbours int, connected boolean")


def _moved(column: str, axis: str) -> tuple[Column, Column]:
    other = "u" if axis == "v" else "v"
    w = Window.partitionBy(*FRAME, other).orderBy(axis)
    return F.lag(column).over(w), F.lead(column).over(w)


def central_normals(points: DataFrame) -> DataFrame:
    """Unit normals by central differences of x, y, z along both axes, towards the camera; zero at borders and bad depths."""
    d = {}
    for axis in ("u", "v"):
        for c in "xyz":
            before, after = _moved(c, axis)
            d[f"{c}{axis}"] = after - before
    p = points.withColumns(d)
    a, b = ([F.col(f"{c}{axis}") for c in "xyz"] for axis in ("u", "v"))
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    s = F.when(n[2] > 0, -1.0).otherwise(1.0)
    good = size.isNotNull() & (size > 0)
    return p.select(*points.columns, *[F.when(good, x * s / size).otherwise(0.0).alias(f"c{k}") for x, k in zip(n, ("nx", "ny", "nz"), strict=True)])


def gradient_normals(px: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Normals from forward differences of depth, taken with mirrored borders."""
    dzu, dzv = (F.coalesce(_moved("z", axis)[1] - F.col("z"), F.col("z") - _moved("z", axis)[0], F.lit(0.0)) for axis in ("u", "v"))
    p = px.withColumns({"dzu": dzu, "dzv": dzv})
    n = [-fx * F.col("dzu"), -fy * F.col("dzv"), F.col("z") + (F.col("u") - cx) * F.col("dzu") + (F.col("v") - cy) * F.col("dzv")]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return p.select(*px.columns, *[F.when(size > 0, x / size).otherwise(0.0).alias(k) for x, k in zip(n, ("gnx", "gny", "gnz"), strict=True)])


def nearest_resize(px: DataFrame, height: int, width: int, new_height: int, new_width: int, value: str) -> DataFrame:
    """Raster at another size: each new pixel takes the pixel it falls on. Each old pixel lists the new ones it fills."""
    def cells(at: str, old: int, new: int) -> Column:
        low = F.ceil(F.col(at) * new / old).cast("int")
        high = (F.ceil((F.col(at) + 1) * new / old) - 1).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    rows = px.withColumn("nv", F.explode(cells("v", height, new_height))).withColumn("nu", F.explode(cells("u", width, new_width)))
    return rows.select(*FRAME, F.col("nv").alias("v"), F.col("nu").alias("u"), value)


def bilinear_resize(px: DataFrame, height: int, width: int, new_height: int, new_width: int, value: str) -> DataFrame:
    """Raster at another size by four weighted taps at pixel centres, with clamped borders."""
    def taps(new: int, old: int, name: str) -> DataFrame:
        spark = px.sparkSession
        at = spark.range(new).select(F.col("id").cast("int").alias(name), F.greatest(F.lit(0.0), F.least(F.lit(old - 1.0), (F.col("id") + 0.5) * old / new - 0.5)).alias("at"))
        low = F.floor("at")
        both = at.select(name, F.explode(F.array(F.struct(low.cast("int").alias("src"), (1 - (F.col("at") - low)).alias("w")), F.struct(F.least(low + 1, F.lit(old - 1)).cast("int").alias("src"), (F.col("at") - low).alias("w")))).alias("t"))
        return both.select(name, F.col("t.src").alias(f"{name}_src"), F.col("t.w").alias(f"{name}_w")).where(F.col(f"{name}_w") > 0)

    tv, tu = taps(new_height, height, "nv"), taps(new_width, width, "nu")  # at most two rows a line or column of the new raster
    rows = px.join(F.broadcast(tv), px["v"] == tv["nv_src"]).join(F.broadcast(tu), px["u"] == tu["nu_src"])
    return rows.groupBy(*FRAME, F.col("nv").alias("v"), F.col("nu").alias("u")).agg(F.sum(F.col(value) * F.col("nv_w") * F.col("nu_w")).alias(value))


def area_resize(px: DataFrame, height: int, width: int, new_height: int, new_width: int, value: str) -> DataFrame:
    """Raster at another size by the mean over the box that each new pixel covers; old pixels count by the share of them inside it.

    The shares of both axes are small tables of at most old + new rows, joined to the pixels; the mean of a raster stays what it was.
    """
    def shares(new: int, old: int, name: str) -> DataFrame:
        at = px.sparkSession.range(new).select(F.col("id").cast("int").alias(name), (F.col("id") * old / new).alias("lo"), ((F.col("id") + 1) * old / new).alias("hi"))
        each = at.select("*", F.explode(F.sequence(F.floor("lo").cast("int"), F.least(F.ceil("hi").cast("int") - 1, F.lit(old - 1)))).alias(f"{name}_src"))
        inside = F.least("hi", F.col(f"{name}_src") + 1.0) - F.greatest("lo", F.col(f"{name}_src") + 0.0)
        return each.select(name, f"{name}_src", (inside * new / old).alias(f"{name}_w")).where(F.col(f"{name}_w") > 1e-12)

    tv, tu = shares(new_height, height, "nv"), shares(new_width, width, "nu")
    rows = px.join(F.broadcast(tv), px["v"] == tv["nv_src"]).join(F.broadcast(tu), px["u"] == tu["nu_src"])
    return rows.groupBy(*FRAME, F.col("nv").alias("v"), F.col("nu").alias("u")).agg(F.sum(F.col(value) * F.col("nv_w") * F.col("nu_w")).alias(value))
