"""PLY meshes: binary and ASCII files to vertex and face tables, and tables to ASCII lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_KINDS = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles as record arrays; the corners are v0, v1, v2. Other polygons are an error."""
    head, _, body = raw.partition(b"end_header\n")
    form, elements = "", []
    for line in head.decode("ascii").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            form = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append((word[-1], word[-2], word[1] == "list" and word[2]))
    order = ">" if form == "binary_big_endian" else "<"
    lines = iter(body.decode("ascii").splitlines()) if form == "ascii" else None
    out, at = {}, 0
    for name, count, props in elements:
        fields = []
        for prop, kind, size in props:
            if size:
                fields += [("sides", order + _KINDS[size]), *((f"v{k}", order + _KINDS[kind]) for k in range(3))]
            else:
                fields.append((prop, order + _KINDS[kind]))
        record = np.dtype(fields)
        if lines is not None:
            out[name] = np.array([tuple(next(lines).split()) for _ in range(count)], dtype=record) if count else np.zeros(0, record)
        else:
            out[name] = np.frombuffer(body, record, count, at)
            at += count * record.itemsize
        if "sides" in record.names and (out[name]["sides"] != 3).any():
            raise ValueError("faces must be triangles")
    return out["vertex"], out["face"]


def binary(vertices: pd.DataFrame, faces: pd.DataFrame, comments: list[str] = ()) -> bytes:
    """Little-endian PLY with plane_id and label_int of each face."""
    head = ["ply", "format binary_little_endian 1.0", *(f"comment {c}" for c in comments), f"element vertex {len(vertices)}", *(f"property float {a}" for a in "xyz"), f"element face {len(faces)}", "property list uchar int vertex_indices", "property int plane_id", "property int label_int", "end_header", ""]
    v = np.zeros(len(vertices), [(a, "<f4") for a in "xyz"])
    f = np.zeros(len(faces), [("sides", "u1"), *((c, "<i4") for c in ("v0", "v1", "v2", "plane_id", "label_int"))])
    for a in "xyz":
        v[a] = vertices[a]
    f["sides"] = 3
    for c in ("v0", "v1", "v2", "plane_id", "label_int"):
        f[c] = faces[c]
    return "\n".join(head).encode() + v.tobytes() + f.tobytes()


def files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """scene_id and content: a binary PLY of each scene (a mesh file is one scene by definition)."""
    ship(faces.sparkSession)

    def one(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scene_id": [key[0]], "content": [binary(v.sort_values("vid"), f.sort_values("fid"), [f"planes {f['plane_id'].nunique()}"])]})

    return vertices.groupBy("scene_id").cogroup(faces.groupBy("scene_id")).applyInPandas(one, "scene_id long, content binary")


def read_faces(rows: DataFrame) -> DataFrame:
    """Faces of meshes given as (scene_id, content)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, raw in zip(batch["scene_id"], batch["content"], strict=True):
                _, f = parse(raw)
                yield pd.DataFrame({"scene_id": scene, "fid": np.arange(len(f)), **{c: f[c].astype(np.int64) for c in ("v0", "v1", "v2")}, **{c: f[c].astype(np.int32) for c in ("plane_id", "label_int")}})

    return rows.select("scene_id", "content").mapInPandas(run, "scene_id long, fid long, v0 long, v1 long, v2 long, plane_id int, label_int int")


def read_vertices(rows: DataFrame) -> DataFrame:
    """Vertices of meshes given as (scene_id, content)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, raw in zip(batch["scene_id"], batch["content"], strict=True):
                v, _ = parse(raw)
                yield pd.DataFrame({"scene_id": scene, "vid": np.arange(len(v)), **{a: v[a].astype(float) for a in "xyz"}})

    return rows.select("scene_id", "content").mapInPandas(run, "scene_id long, vid long, x double, y double, z double")


def from_folder(spark: SparkSession, path: str, scene: str = r"([0-9]+)[.]ply$") -> DataFrame:
    """(scene_id, content) of a folder of PLY files; the scene is a number in the name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path)
    return found.select(F.regexp_extract("path", scene, 1).cast("long").alias("scene_id"), "content")


def ascii_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """scene_id, part, at and line of an ASCII PLY: header, vertices, faces in that order."""
    counts = vertices.groupBy("scene_id").agg(F.count("*").alias("nv")).join(faces.groupBy("scene_id").agg(F.count("*").alias("nf")), "scene_id")
    head = F.array(F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("nv").cast("string")), *[F.lit(f"property float {a}") for a in "xyz"], F.concat(F.lit("element face "), F.col("nf").cast("string")), F.lit("property list uchar int vertex_indices"), F.lit("property int plane_id"), F.lit("end_header"))
    top = counts.select("scene_id", F.lit(0).alias("part"), F.posexplode(head).alias("at", "line")).select("scene_id", "part", F.col("at").cast("long").alias("at"), "line")
    v = vertices.select("scene_id", F.lit(1).alias("part"), F.col("vid").alias("at"), F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("line"))
    f = faces.select("scene_id", F.lit(2).alias("part"), F.col("fid").alias("at"), F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2", "plane_id").alias("line"))
    return top.union(v).union(f)
