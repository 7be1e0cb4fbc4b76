"""Order-dependent and random group kernels: one small NumPy function a group, Spark deals the groups.

A group is what the operator's definition needs together: a segment, a class of a frame or a label of a scene. ``seeded``
makes draws depend on the group's key alone, so results are the same on any partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def seeded(seed: int, *key: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr([int(k) if isinstance(k, np.integer) else k for k in key]).encode())])


def pca_plane(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit normal and d >= 0 of the least-squares plane n·x + d = 0."""
    c = p.mean(axis=0)
    n = np.linalg.svd(p - c, full_matrices=False)[2][-1]
    d = -float(n @ c)
    return (-n, -d) if d < 0 else (n, d)


def ransac(p: np.ndarray, threshold: float, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Inliers of the best plane through three drawn points; draws are made and judged in one batch."""
    pick = rng.integers(0, len(p), (iterations, 3))
    a, b, c = p[pick[:, 0]], p[pick[:, 1]], p[pick[:, 2]]
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    n, a = n[size > 1e-8] / size[size > 1e-8, None], a[size > 1e-8]
    best, most = np.zeros(len(p), bool), 0
    for i in range(0, len(n), 64):
        near = np.abs(p @ n[i : i + 64].T - (n[i : i + 64] * a[i : i + 64]).sum(axis=1)) < threshold
        counts = near.sum(axis=0)
        if counts.size and counts.max() > most:
            most = int(counts.max())
            best = near[:, int(counts.argmax())]
    return best


def huber_plane(p: np.ndarray, iterations: int = 8, k: float = 1.345, eps: float = 1e-6) -> tuple[np.ndarray, float]:
    """Iteratively reweighted plane: Huber weights at 1.345 times the robust scale of the residuals."""
    n, d = pca_plane(p)
    for _ in range(iterations):
        r = np.abs(p @ n + d)
        c = k * 1.4826 * (np.median(r) + 1e-12) + 1e-12
        w = np.where(r <= c, 1.0, c / np.maximum(r, 1e-300))
        m = (p * w[:, None]).sum(axis=0) / w.sum()
        new = np.linalg.svd((p - m) * np.sqrt(w)[:, None], full_matrices=False)[2][-1]
        new_d = -float(new @ m)
        new, new_d = (-new, -new_d) if new_d < 0 else (new, new_d)
        done = np.linalg.norm(new - n) < eps and abs(new_d - d) < eps
        n, d = new, new_d
        if done:
            break
    return n, d


def _points(rows: pa.Table) -> np.ndarray:
    """The points of a group, in an order that does not depend on the partitioning."""
    p = np.column_stack([rows.column(c).to_numpy() for c in "xyz"]).astype(float)
    return p[np.lexsort(p.T[::-1])]


def _one_row(keys: list[str], kinds: dict[str, str], fit: Callable[[tuple, np.ndarray], dict | None], columns: str):
    """Groups' points to a row each by ``fit``, or to none; in Arrow, since a frame of pandas for each small group costs more than the fits."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.float64() for c in columns.split(", ")]

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        found = fit(tuple(k.as_py() for k in key), _points(rows))
        head = {c: rows.column(c).slice(0, 1 if found else 0) for c in keys}
        return pa.table({**head, **{c: pa.array([found[c]] if found else [], t) for c, t in zip(names, types, strict=True)}})

    return one, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", " + columns


def label_regions(px: DataFrame, mask: str, eight: bool = True, by: tuple[str, ...] = ("scene_id", "frame_id")) -> DataFrame:
    """Pixels with their connected region, numbered from 1 in each frame by its first pixel in row order; 0 outside the mask.

    A frame (or what ``by`` makes one) is one group: runs of a row are joined to the runs they touch in the row above.
    """
    ship(px.sparkSession)
    reach = 1 if eight else 0

    def frame(rows: pa.Table) -> pa.Table:
        v, u, on = rows.column("v").to_numpy(), rows.column("u").to_numpy(), rows.column(mask).to_numpy(zero_copy_only=False).astype(bool)
        plane = np.zeros((v.max() - v.min() + 1, u.max() - u.min() + 3), np.int8)
        plane[v - v.min(), u - u.min() + 1] = on
        step = np.diff(plane, axis=1)
        row, lo = np.nonzero(step == 1)
        hi = np.nonzero(step == -1)[1]
        root = list(range(len(row)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        first = np.searchsorted(row, np.arange(plane.shape[0] + 1))
        for r in range(1, plane.shape[0]):
            a, b = first[r - 1], first[r]
            while a < first[r] and b < first[r + 1]:
                if lo[a] < hi[b] + reach and lo[b] < hi[a] + reach:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
                a, b = (a + 1, b) if hi[a] < hi[b] else (a, b + 1)
        roots = np.array([find(k) for k in range(len(row))], int)
        number = np.zeros(len(row) + 1, np.int32)
        number[np.unique(roots)] = np.arange(1, len(np.unique(roots)) + 1)
        out = np.zeros(plane.shape, np.int32)
        for k in range(len(row)):
            out[row[k], lo[k] + 1 : hi[k] + 1] = number[roots[k]]
        return pa.table([rows.column(c) for c in head] + [pa.array(out[v - v.min(), u - u.min() + 1])], names=[*head, "region"])

    kinds, head = dict(px.dtypes), [*by, "v", "u"]
    return px.select(*head, mask).groupBy(*by).applyInArrow(frame, ", ".join(f"{c} {kinds[c]}" for c in head) + ", region int")


def drop_small(px: DataFrame, label: str, least: int, keys: tuple[str, ...] = ("scene_id", "frame_id")) -> DataFrame:
    """Labelled pixels (keys, v, u, label) but those in a 4-connected component of their label below ``least`` pixels."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    by = (*keys, label)
    found = label_regions(px.where(F.col(label) > 0).withColumn("_on", F.lit(True)), "_on", eight=False, by=by)
    size = F.count("*").over(Window.partitionBy(*by, "region"))
    return found.withColumn("_size", size).where(F.col("_size") >= least).select(*keys, "v", "u", label)


def robust_fits(points: DataFrame, keys: list[str], threshold: float = 0.01, iterations: int = 1000, support: int = 50, seed: int = 0) -> DataFrame:
    """RANSAC and least-squares refinement of each segment: counts, ratios and rms over the RANSAC inliers.

    Segments of fewer than max(support, 3) points, or of fewer inliers than ``support``, have no plane.
    """
    ship(points.sparkSession)

    def fit(key: tuple, p: np.ndarray) -> dict | None:
        p = p[np.isfinite(p).all(axis=1)]
        if len(p) < max(support, 3):
            return None
        near = ransac(p, threshold, iterations, seeded(seed, *key))
        if near.sum() < max(support, 3):
            return None
        n, d = pca_plane(p[near])
        r = np.abs(p @ n + d)
        refined = int((r < threshold).sum())
        counts = {"num_points": len(p), "ransac_inliers": int(near.sum()), "refined_inliers": refined}
        return {**dict(zip("abc", n.tolist(), strict=True)), "d": d, **counts, "inlier_ratio_ransac": near.sum() / len(p), "inlier_ratio_refined": refined / len(p), "rms": float(np.sqrt((r[near] ** 2).mean()))}

    one, schema = _one_row(keys, dict(points.dtypes), fit, "a double, b double, c double, d double, num_points long, ransac_inliers long, refined_inliers long, inlier_ratio_ransac double, inlier_ratio_refined double, rms double")
    return points.select(*keys, "x", "y", "z").groupBy(*keys).applyInArrow(one, schema)


def huber_fits(points: DataFrame, keys: list[str]) -> DataFrame:
    """Huber plane of each group of three points or more."""
    ship(points.sparkSession)

    def fit(key: tuple, p: np.ndarray) -> dict | None:
        if len(p) < 3:
            return None
        n, d = huber_plane(p)
        return {**dict(zip("abc", n.tolist(), strict=True)), "d": d, "num_points": len(p)}

    one, schema = _one_row(keys, dict(points.dtypes), fit, "a double, b double, c double, d double, num_points long")
    return points.select(*keys, "x", "y", "z").groupBy(*keys).applyInArrow(one, schema)


def sequential_planes(points: DataFrame, keys: list[str], threshold: float = 0.05, cosine: float = 0.94, iterations: int = 500, least: int = 50, most: int = 50, seed: int = 0) -> DataFrame:
    """Planes of a group one after the other: RANSAC with refits, its inliers removed, until too few points agree.

    ``points``: keys, idx, x, y, z and normals nx, ny, nz. A row for each point that a plane took.
    """
    ship(points.sparkSession)
    head = ", ".join(f"{c} {t}" for c, t in points.select(*keys).dtypes)
    columns = [*keys, "idx", "plane", "a", "b", "c", "d"]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        p, n, idx = rows[["x", "y", "z"]].to_numpy(float), rows[["nx", "ny", "nz"]].to_numpy(float), rows["idx"].to_numpy()
        size, z = np.linalg.norm(n, axis=1), np.maximum(1.0, p[:, 2] / 10.0)
        left, out, rng = np.arange(len(p)), [], seeded(seed, *key)

        def inliers(m: np.ndarray, d: float) -> np.ndarray:
            return left[(np.abs(p[left] @ m + d) < threshold * z[left]) & ((np.abs(n[left] @ m) > cosine) | (size[left] < 0.5))]

        for plane in range(1, most + 1):
            if len(left) < max(least, 3):
                break
            best = np.zeros(0, int)
            for pick in rng.integers(0, len(left), (iterations, 3)):
                a, b, c = p[left[pick]]
                m = np.cross(b - a, c - a)
                if (s := np.linalg.norm(m)) < 1e-8:
                    continue
                got = inliers(m / s, -float(m @ a) / s)
                if len(got) > len(best):
                    best = got
                    for _ in range(10):
                        again = inliers(*pca_plane(p[best]))
                        if len(again) <= len(best):
                            break
                        best = again
            if len(best) < least:
                break
            m, d = pca_plane(p[best])
            out.append(pd.DataFrame({**dict(zip(keys, key, strict=True)), "idx": idx[best], "plane": plane, "a": m[0], "b": m[1], "c": m[2], "d": d}))
            left = np.setdiff1d(left, best)
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return points.groupBy(*keys).applyInPandas(one, f"{head}, idx long, plane int, a double, b double, c double, d double")


def face_planes(faces: DataFrame, keys: list[str], distance: float, degrees: float, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """Best plane through three distinct vertices of a group's faces, as it was drawn, and the faces that agree with it.

    ``faces``: keys, fid, normals, centroids and corners with their vertices. A face agrees if its centroid is near the plane
    and its normal is within ``degrees`` of the plane's, of either sign. There is no refinement. Of planes that as many
    faces agree with the first drawn is taken.
    """
    ship(faces.sparkSession)
    cos = np.cos(np.radians(degrees))
    head = ", ".join(f"{c} {t}" for c, t in faces.select(*keys).dtypes)
    columns = [*keys, "fid", "a", "b", "c", "d"]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fid")
        ids, first = np.unique(part[["v0", "v1", "v2"]].to_numpy().reshape(-1), return_index=True)
        p = np.stack([part[[f"{a}{k}" for a in "xyz"]].to_numpy(float) for k in range(3)], axis=1).reshape(-1, 3)[first]
        if len(ids) < 3:
            return pd.DataFrame(columns=columns)
        rng = seeded(seed, *key)
        pick = np.stack([rng.choice(len(ids), 3, replace=False) for _ in range(iterations)])
        a, b, c = p[pick[:, 0]], p[pick[:, 1]], p[pick[:, 2]]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n, axis=1)
        n, a = n[size > 1e-12] / size[size > 1e-12, None], a[size > 1e-12]
        middle, normal = part[["cx", "cy", "cz"]].to_numpy(float), part[["nx", "ny", "nz"]].to_numpy(float)
        best, most = None, 0
        for i in range(0, len(n), 64):
            d = -(n[i : i + 64] * a[i : i + 64]).sum(axis=1)
            agree = (np.abs(middle @ n[i : i + 64].T + d) <= distance) & (np.abs(normal @ n[i : i + 64].T) >= cos)
            counts = agree.sum(axis=0)
            if counts.max() > most:
                k = int(counts.argmax())
                best, most = (agree[:, k], n[i + k], d[k]), int(counts[k])
        if best is None:
            return pd.DataFrame(columns=columns)
        took, n, d = best
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "fid": part["fid"].to_numpy()[took], "a": n[0], "b": n[1], "c": n[2], "d": d})[columns]

    return faces.groupBy(*keys).applyInPandas(one, f"{head}, fid long, a double, b double, c double, d double")


def grow_regions(faces: DataFrame, near: DataFrame, degrees: float = 8.0, distance: float = 0.015, dihedral: float = 55.0, refit: int = 15, least: int = 1) -> DataFrame:
    """Label-strict region growing on faces with corners, normals, centroids and areas.

    Seeds by area (ties: smaller fid); depth-first over neighbours of the same label under a dihedral gate, a gate on the angle to
    the plane and a distance gate of two of the three corners; the plane is refitted to the distinct vertices after every
    ``refit`` faces that are taken from the stack. A region of fewer than ``least`` faces is none. A scene's label is one group, since the result depends on the order of visits. Returns scene_id, fid, label_int, region.
    """
    ship(faces.sparkSession)
    cos_p, cos_d = np.cos(np.radians(degrees)), np.cos(np.radians(dihedral))
    links = near.groupBy("scene_id", "f1").agg({"f2": "collect_list"}).withColumnRenamed("collect_list(f2)", "next").withColumnRenamed("f1", "fid")
    rows = faces.join(links, ["scene_id", "fid"], "left").select("scene_id", "label_int", "fid", "area", "nx", "ny", "nz", "v0", "v1", "v2", *[f"{a}{k}" for a in "xyz" for k in range(3)], "next")

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["area", "fid"], ascending=[False, True]).reset_index(drop=True)
        at = {f: k for k, f in enumerate(part["fid"])}
        corner = np.stack([part[[f"{a}{k}" for a in "xyz"]].to_numpy(float) for k in range(3)], axis=1)
        normal = part[["nx", "ny", "nz"]].to_numpy(float)
        vertex = part[["v0", "v1", "v2"]].to_numpy()
        region, number = np.full(len(part), -1), 0
        for seed in range(len(part)):
            if region[seed] != -1:
                continue
            n, d = pca_plane(corner[seed])
            took, stack, since = [], [seed], 0
            region[seed] = number
            while stack:
                u = stack.pop()
                took.append(u)
                since += 1
                if since >= refit:
                    first = np.unique(vertex[took].reshape(-1), return_index=True)[1]
                    n, d = huber_plane(corner[took].reshape(-1, 3)[first], 4)
                    since = 0
                for f in sorted(part["next"][u] if part["next"][u] is not None else []):
                    v = at.get(f)
                    if v is None or region[v] != -1 or abs(normal[u] @ normal[v]) < cos_d or abs(normal[v] @ n) < cos_p or (np.abs(corner[v] @ n + d) <= distance).sum() < 2:
                        continue
                    region[v] = number
                    stack.append(v)
            if len(took) < least:
                region[took] = -2
            else:
                number += 1
        return pd.DataFrame({"scene_id": key[0], "label_int": key[1], "fid": part["fid"], "region": np.where(region < 0, -1, region)})

    return rows.groupBy("scene_id", "label_int").applyInPandas(one, "scene_id long, label_int int, fid long, region int")


def touching(v: np.ndarray, u: np.ndarray, label: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (a < b, a row each) of labels with pixels within ``radius`` (Euclidean) of each other; pixels may have several labels."""
    number, at = np.unique(label, return_inverse=True)
    v, u = v - v.min(), u - u.min() + radius
    shape = (int(v.max()) + 1 + radius, int(u.max()) + 1 + radius)
    layers, left = [], np.arange(len(v))
    while len(left):
        first = np.unique(v[left].astype(np.int64) * shape[1] + u[left], return_index=True)[1]
        plane = np.full(shape, -1, np.int64)
        plane[v[left[first]], u[left[first]]] = at[left[first]]
        layers.append(plane)
        left = np.delete(left, first)
    met, (h, w) = np.zeros(0, np.int64), shape
    for dv in range(radius + 1):
        for du in range(-radius if dv else 0, radius + 1):
            if dv * dv + du * du > radius * radius:
                continue
            for x in layers:
                for y in layers:
                    p, q = x[: h - dv, max(0, -du) : w - max(0, du)], y[dv:, max(0, du) : w + min(0, du)]
                    on = (p >= 0) & (q >= 0) & (p != q)
                    if on.any():
                        met = np.union1d(met, np.minimum(p[on], q[on]) * len(number) + np.maximum(p[on], q[on]))
    return np.column_stack([number[met // len(number)], number[met % len(number)]])


def merge_segments(px: DataFrame, label: str = "label", degrees: float = 10.0, offset: float = 0.02, least: int = 50, gap: int = 5, rounds: int = 20) -> DataFrame:
    """Greedy merge of a frame's segments within ``gap`` pixels, largest pair first, while normals, of either sign, and mean depths agree.

    A round judges all touching pairs by its start and merges those whose ends no merge of the round has taken up, so
    a segment may take up several. Of pairs of one size the later labels go first.

    A frame is one group; what is merged there are its segments' sums. Returns the new label of each.
    """
    ship(px.sparkSession)
    cos, frame = np.cos(np.radians(degrees)), ["scene_id", "frame_id"]

    def one(key: tuple, part: pa.Table) -> pa.Table:
        v, u, labels = (part.column(c).to_numpy() for c in ("v", "u", label))
        own, at = np.unique(labels, return_inverse=True)

        def total(c: pa.ChunkedArray) -> np.ndarray:
            """Sums by segment as SQL makes them: nulls do not count, a segment of nulls alone has none."""
            return np.where(np.bincount(at, c.is_valid().to_numpy()) > 0, np.bincount(at, c.fill_null(0).to_numpy()), np.nan)

        sums = np.column_stack([np.bincount(at), *[total(part.column(c)) for c in ("nx", "ny", "nz", "z")]])
        rows = dict(zip(own.tolist(), sums, strict=True))
        touch = {tuple(p) for p in touching(v, u, labels, gap).tolist()}
        root = {a: a for a in rows}
        for _ in range(rounds):
            agree = []
            for a, b in touch:
                x, y = rows[a], rows[b]
                if min(x[0], y[0]) < least:
                    continue
                sizes = np.linalg.norm(x[1:4]) / x[0], np.linalg.norm(y[1:4]) / y[0]
                if min(sizes) < 1e-6:
                    continue
                dot = (x[1:4] @ y[1:4]) / (sizes[0] * sizes[1] * x[0] * y[0])
                if abs(dot) >= cos and abs(x[4] / x[0] - y[4] / y[0]) <= offset:
                    agree.append((x[0] + y[0], a, b))
            gone: dict[int, int] = {}
            for _, a, b in sorted(agree, reverse=True):
                if a not in gone and b not in gone:
                    rows[a] = rows[a] + rows[b]
                    gone[b] = a
            if not gone:
                break

            def end(k: int, gone: dict[int, int] = gone) -> int:
                while k in gone:
                    k = gone[k]
                return k

            root = {k: end(v) for k, v in root.items()}
            touch = {tuple(sorted((end(i), end(j)))) for i, j in touch if end(i) != end(j)}
        head = {c: pa.array([k.as_py()] * len(root), pa.int64()) for c, k in zip(frame, key, strict=True)}
        return pa.table({**head, "label": pa.array(list(root), pa.int32()), "merged": pa.array(list(root.values()), pa.int32())})

    own = px.where(F.col(label) > 0).select(*frame, "v", "u", label, "nx", "ny", "nz", "z")
    return own.groupBy(*frame).applyInArrow(one, "scene_id long, frame_id long, label int, merged int")
