"""Camera and plane formulas as column expressions, so that they stay inside generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pinhole:
    """Intrinsics, and a camera-to-world pose in rows (identity by default)."""

    fx: float
    fy: float
    cx: float
    cy: float
    pose: tuple[tuple[float, float, float, float], ...] = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))

    def resized(self, sx: float, sy: float) -> Pinhole:
        return Pinhole(self.fx * sx, self.fy * sy, self.cx * sx, self.cy * sy, self.pose)


def from_projection(m00: float, m11: float, width: int, height: int) -> Pinhole:
    """Intrinsics of a projection matrix whose pixel grid runs from 0 to width - 1."""
    return Pinhole(m00 * (width - 1) / 2, m11 * (height - 1) / 2, (width - 1) / 2, (height - 1) / 2)


def valid_depth(z: str) -> Column:
    c = F.col(z)
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return out


def _posed(p: Pinhole, x: Column, y: Column, z: Column) -> list[Column]:
    return [x * r[0] + y * r[1] + z * r[2] + r[3] for r in p.pose]


def backproject(p: Pinhole, z: str = "z", u: str = "u", v: str = "v", origin: int = 0, up: bool = False) -> list[Column]:
    """World x, y, z of a pixel with a depth. ``origin`` 1 counts pixel centres from 1; ``up`` points y upwards."""
    depth = F.col(z)
    x = (F.col(u) + origin - p.cx) * depth / p.fx
    y = (F.col(v) + origin - p.cy) * depth / p.fy
    return _posed(p, x, -y if up else y, depth)


def row_backproject(z: str = "z", u: str = "u", v: str = "v") -> list[Column]:
    """World x, y, z of a pixel whose row has its camera: fx, fy, cx, cy, and the pose ``c2w`` (16 numbers, rows first)."""
    depth = F.col(z)
    x, y = (F.col(u) - F.col("cx")) * depth / F.col("fx"), (F.col(v) - F.col("cy")) * depth / F.col("fy")
    at = lambda k: F.get("c2w", F.lit(k))
    return [x * at(4 * r) + y * at(4 * r + 1) + depth * at(4 * r + 2) + at(4 * r + 3) for r in range(3)]


def ray_length(p: Pinhole, u: str = "u", v: str = "v") -> Column:
    """Length of a pixel's ray for depth 1."""
    x, y = (F.col(u) - p.cx) / p.fx, (F.col(v) - p.cy) / p.fy
    return F.sqrt(x * x + y * y + 1)


def euclidean_to_z(d: str, p: Pinhole) -> Column:
    return F.col(d) / ray_length(p)


def matrix_ray(m: list[list[float]], width: int, height: int, u: str = "u", v: str = "v") -> list[Column]:
    """Direction of a pixel under a matrix from normalised device coordinates to camera space."""
    a = (F.col(u) + 0.5) * 2.0 / width - 1
    b = 1 - (F.col(v) + 0.5) * 2.0 / height
    return [a * r[0] + b * r[1] + F.lit(float(r[2])) for r in m]


def matrix_backproject(d: str, m: list[list[float]], width: int, height: int) -> list[Column]:
    """Point at Euclidean distance ``d`` along the pixel's ray."""
    ray = matrix_ray(m, width, height)
    n = F.sqrt(sum((c * c for c in ray[1:]), ray[0] * ray[0]))
    return [F.col(d) * c / n for c in ray]


def matrix_euclidean_to_z(d: str, m: list[list[float]], width: int, height: int) -> Column:
    ray = matrix_ray(m, width, height)
    return F.col(d) * F.abs(ray[2]) / F.sqrt(sum((c * c for c in ray[1:]), ray[0] * ray[0]))


def project(p: Pinhole, x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """Camera-space point to pixel u, v; casts truncate towards 0."""
    return [(F.col(x) / F.col(z) * p.fx + p.cx).cast("int"), (F.col(y) / F.col(z) * p.fy + p.cy).cast("int")]


def inside(u: str, v: str, width: int, height: int) -> Column:
    return (F.col(u) >= 0) & (F.col(u) < width) & (F.col(v) >= 0) & (F.col(v) < height)


def norm(*c: Column) -> Column:
    return F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(c: list[Column]) -> list[Column]:
    n = norm(*c)
    return [F.when(n > 0, x / n).otherwise(0.0) for x in c]


def upright(n: list[Column], d: Column) -> list[Column]:
    """Plane n·x + d = 0 with unit normal and d >= 0."""
    s = F.when(d < 0, -1.0).otherwise(1.0) / norm(*n)
    return [*(x * s for x in n), d * s]


def angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between unit vectors, signed directions apart."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def three_points(a: list[Column], b: list[Column], c: list[Column]) -> list[Column]:
    """Plane through three points with d >= 0; null where they are on a line."""
    n = cross([y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)])
    flat = norm(*n) < 1e-12
    return [F.when(~flat, x) for x in upright(n, -dot(n, a))]


def basis(n: list[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit vectors across a unit normal."""
    away = F.abs(n[0]) < 0.9
    axis = [F.when(away, 1.0).otherwise(0.0), F.when(away, 0.0).otherwise(1.0), F.lit(0.0)]
    first = unit(cross(n, axis))
    return first, cross(n, first)


def rgb_depth(r: str, g: str, b: str) -> Column:
    """Metres of a depth stored in three colour channels, the far end at 5000 m."""
    return 5000.0 * (F.col(r) + 256.0 * F.col(g) + 65536.0 * F.col(b)) / (2.0**24 - 1)


def millimetres(z: str) -> Column:
    """Depth as unsigned 16-bit millimetres, clipped; halves round to even."""
    return F.least(F.greatest(F.rint(F.col(z) * 1000.0), F.lit(0.0)), F.lit(65535.0)).cast("int")


def from_inverse(a: str, b: str, c: str) -> list[Column]:
    """Plane stored as n / d: unit normal and d."""
    size = norm(F.col(a), F.col(b), F.col(c))
    return [F.col(a) / size, F.col(b) / size, F.col(c) / size, 1.0 / size]


def adaptive_inlier(distance: Column, cosine: Column, normal_size: Column, depth: Column, threshold: float, least_cosine: float, reference: float = 10.0) -> Column:
    """Inlier under a tolerance that grows with depth; pixels without a normal pass the angle test."""
    return (distance < threshold * F.greatest(F.lit(1.0), depth / reference)) & ((F.abs(cosine) > least_cosine) | (normal_size < 0.5))


def tone(value: str, exposure: Column, gamma: float = 2.2) -> Column:
    return F.pow(F.least(F.greatest(F.nanvl(F.col(value), F.lit(0.0)) * exposure, F.lit(0.0)), F.lit(1.0)), F.lit(1.0 / gamma))


def rotated(x: Column, y: Column, z: Column, pitch: float, yaw: float) -> list[Column]:
    """Points turned by Ry(yaw) · Rx(pitch), in degrees."""
    from math import cos, radians, sin

    a, b = radians(pitch), radians(yaw)
    y2, z2 = y * cos(a) - z * sin(a), y * sin(a) + z * cos(a)
    return [x * cos(b) + z2 * sin(b), y2, z2 * cos(b) - x * sin(b)]


def onto_plane(p: list[Column], n: list[Column], d: Column) -> list[Column]:
    """Nearest point of the plane n·x + d = 0."""
    t = dot(p, n) + d
    return [x - t * m for x, m in zip(p, n, strict=True)]


def onto_plane_by_ray(p: list[Column], n: list[Column], d: Column, most: float = 0.3) -> list[Column]:
    """Where the ray through the camera meets the plane, unless that moves the point by more than ``most``."""
    along = dot(p, n)
    t = F.when(F.abs(along) > 1e-8, -d / along)
    moved = F.abs(t - 1) * norm(*p)
    return [F.when(t.isNotNull() & (moved <= most), x * t).otherwise(x) for x in p]
