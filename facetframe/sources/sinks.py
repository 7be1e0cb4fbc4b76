"""File sinks as Spark data sources: a raster or a mesh to a file, with a commit protocol.

Tasks write to a folder of their own job under ``_pending``, each attempt under a new name. The driver's commit moves only the files
of attempts that Spark has accepted, so a task that is run again leaves one file, and a job that fails leaves none. Rows
of a file must come together and in order; ``save_rasters`` and ``save_meshes`` see to that, one shuffle each.
"""

from __future__ import annotations

import io
import re
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship

LABEL_MOST = 65535


def place_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of an absolute local path."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt has written: where it lies and where it belongs."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FileWriter(DataSourceArrowWriter):
    """Writes groups of rows to files and moves them into place on commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.template = options["template"]
        self.keys = [name for _, name, _, _ in string.Formatter().parse(self.template) if name]
        self.job = uuid.uuid4().hex

    def pending(self) -> str:
        return f"{self.root}/_pending/{self.job}"

    def content(self, rows: Iterator[pa.Table]) -> Iterator[bytes]:
        """The bytes of a file, from its rows in order, a part at a time."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = place_of(self.pending())
        out, told = None, Written()

        def runs() -> Iterator[tuple[tuple, pa.Table]]:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                codes = pd.MultiIndex.from_arrays([batch.column(k).to_pandas() for k in self.keys]).factorize()[0]
                edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    part = pa.Table.from_batches([batch.slice(a, b - a)])
                    yield tuple(part.column(k)[0].as_py() for k in self.keys), part

        source = runs()
        ahead = next(source, None)
        while ahead is not None:
            key = ahead[0]

            def own() -> Iterator[pa.Table]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:  # noqa: B023
                    yield ahead[1]
                    ahead = next(source, None)

            name = self.template.format(**dict(zip(self.keys, key, strict=True)))
            temporary = f"{at}/{uuid.uuid4().hex}"
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(temporary) as out:
                for part in self.content(own()):
                    out.write(part)
            for _ in own():
                pass
            told.files.append((temporary, name))
        return told

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = place_of(self.root)
        moves = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of one file were dealt to several tasks")
        if self.overwrite and fs.get_file_info(root).type != pafs.FileType.NotFound:
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if info.base_name != "_pending":
                    (fs.delete_dir if info.type == pafs.FileType.Directory else fs.delete_file)(info.path)
        for temporary, name in moves:
            folder = f"{root}/{name}".rpartition("/")[0]
            fs.create_dir(folder, recursive=True)
            fs.move(temporary, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, at = place_of(self.pending())
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)
        above = at.rpartition("/")[0]
        if fs.get_file_info(above).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(raster: np.ndarray) -> bytes:
    """A 16-bit grey PNG of whole numbers; those outside 0 to 65535 are clipped."""
    h, w = raster.shape
    lines = np.zeros((h, 1 + 2 * w), np.uint8)
    lines[:, 1:] = np.clip(raster, 0, LABEL_MOST).astype(">u2").view(np.uint8).reshape(h, -1)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """The raster of a grey PNG of 8 or 16 bits, not interlaced; all five line filters."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body = 8, b""
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        part = raw[at + 8 : at + 8 + size]
        if struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if colour or interlaced or depth not in (8, 16):
                raise ValueError("only grey PNG of 8 or 16 bits")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    step = depth // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + step * w)
    out = np.zeros((h + 1, step * (w + 1)), np.int64)
    for v in range(h):
        line, now, up = lines[v, 1:].astype(np.int64), out[v + 1], out[v]
        kind = lines[v, 0]
        if kind in (0, 2):
            now[step:] = (line + (up[step:] if kind == 2 else 0)) & 255
            continue
        for k in range(step, len(now)):
            a, b, c = now[k - step], up[k], up[k - step]
            if kind == 1:
                guess = a
            elif kind == 3:
                guess = (a + b) // 2
            else:
                q = a + b - c
                guess = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
            now[k] = (line[k - step] + guess) & 255
    bytes_ = out[1:, step:].astype(np.uint8)
    return (bytes_.reshape(h, w, step).astype(np.int64) * (np.array([256, 1]) if step == 2 else 1)).sum(axis=2).astype(np.int64)


def encode_npy(raster: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, raster, allow_pickle=False)
    return out.getvalue()


class RasterWriter(FileWriter):
    """Pixels (keys, v, u, value) to one raster a file; missing pixels are 0. One raster is held at a time."""

    def __init__(self, options: dict, overwrite: bool, encode: Callable[[np.ndarray], bytes]):
        super().__init__(options, overwrite)
        self.value, self.encode = options.get("value", "label"), encode

    def content(self, rows: Iterator[pa.Table]) -> Iterator[bytes]:
        part = pa.concat_tables(rows)
        v, u = part.column("v").to_numpy(), part.column("u").to_numpy()
        raster = np.zeros((int(v.max()) + 1, int(u.max()) + 1), part.column(self.value).type.to_pandas_dtype())
        raster[v, u] = part.column(self.value).fill_null(0).to_numpy()
        yield self.encode(raster)


class LabelPng(DataSource):
    """``df.write.format("label_png").option("template", "{scene_id}/{frame_id}.png").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "label_png"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return RasterWriter(self.options, overwrite, encode_png)


class RasterNpy(DataSource):
    """As ``label_png``, for NumPy files of the value's own type."""

    @classmethod
    def name(cls) -> str:
        return "raster_npy"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return RasterWriter(self.options, overwrite, encode_npy)


class PlyWriter(FileWriter):
    """Rows of a mesh in order: header lines (part 0), vertices (part 1), faces (part 2) to a little-endian PLY, batch by batch."""

    def content(self, rows: Iterator[pa.Table]) -> Iterator[bytes]:
        for table in rows:
            part = table.column("part").to_numpy()
            for k in (0, 1, 2):
                own = table.filter(pa.array(part == k))
                if not own.num_rows:
                    continue
                if k == 0:
                    yield "".join(f"{line}\n" for line in own.column("line").to_pylist()).encode("ascii", "replace")
                elif k == 1:
                    yield np.stack([own.column(a).to_numpy() for a in "xyz"], axis=1).astype("<f4").tobytes()
                else:
                    faces = np.zeros(own.num_rows, [("sides", "u1"), *((c, "<i4") for c in ("v0", "v1", "v2", "plane_id", "label_int"))])
                    faces["sides"] = 3
                    for c in ("v0", "v1", "v2", "plane_id", "label_int"):
                        faces[c] = own.column(c).to_numpy()
                    yield faces.tobytes()


class PlaneMesh(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plane_mesh"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return PlyWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the sinks known to a session."""
    ship(spark)
    for source in (LabelPng, RasterNpy, PlaneMesh):
        spark.dataSource.register(source)
    return spark


def remapped(px: DataFrame, label: str, table: DataFrame, key: str, value: str, counts: Observation | None = None) -> DataFrame:
    """Labels replaced by ``table``'s; unmapped ones become 0. ``counts`` observes pixels and unmapped when the result is used."""
    known = table.select(F.col(key).alias(label), F.col(value).alias("_new"))
    out = px.join(known, label, "left")
    if counts is not None:
        out = out.observe(counts, F.count("*").alias("pixels"), F.count_if(F.col("_new").isNull()).alias("unmapped"))
    return out.withColumn(label, F.coalesce("_new", F.lit(0))).drop("_new").select(*px.columns)


def save_rasters(px: DataFrame, path: str, template: str = "{scene_id}/{frame_id}.png", value: str = "label", form: str = "label_png", mode: str = "append") -> None:
    """A file for each raster of pixels (the template's columns, v, u, ``value``)."""
    keys = [name for _, name, _, _ in string.Formatter().parse(template) if name]
    register(px.sparkSession)
    rows = px.select(*keys, "v", "u", value).repartition(*keys).sortWithinPartitions(*keys, "v", "u")
    rows.write.format(form).option("template", template).option("value", value).mode(mode).save(path)


def listed(spark: SparkSession, path: str, pattern: str, names: list[str], glob: str = "*") -> DataFrame:
    """Files below ``path`` whose path ends in ``pattern``: its groups as text columns ``names``, and path and bytes. Contents are not read, and files
    of no length are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("bytes"))
    found = files.where(F.col("path").rlike(pattern) & ~F.col("path").contains("/_pending/"))
    return found.select(*[F.regexp_extract("path", pattern, k + 1).alias(n) for k, n in enumerate(names)], "path", "bytes")


def whole_frames(files: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Frames (keys) that have a file of some length of each of the ``kinds``, from a listing (keys, kind, bytes)."""
    seen = files.where(F.col("kind").isin(kinds) & (F.col("bytes") > 0)).groupBy(*keys).agg(F.count_distinct("kind").alias("_n"))
    return seen.where(F.col("_n") == len(kinds)).select(*keys)


def read_rasters(spark: SparkSession, path: str, pattern: str, names: list[str], value: str = "label", glob: str = "*") -> DataFrame:
    """Pixels (names as text, v, u, value) of PNG or NumPy files below ``path``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.where(F.col("path").rlike(pattern)).select(*[F.regexp_extract("path", pattern, k + 1).alias(n) for k, n in enumerate(names)], "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, raw in batch.itertuples(index=False):
                raster = decode_png(raw) if raw[:4] == b"\x89PNG" else np.load(io.BytesIO(raw), allow_pickle=False)
                v, u = np.divmod(np.arange(raster.size), raster.shape[1])
                yield pd.DataFrame({**dict(zip(names, key, strict=True)), "v": v, "u": u, value: raster.reshape(-1).astype(float)})

    return rows.mapInPandas(run, ", ".join(f"{n} string" for n in names) + f", v int, u int, {value} double")


def save_missing(px: DataFrame, path: str, template: str, pattern: str, value: str, form: str = "raster_npy") -> int:
    """Saves the rasters that ``path`` has no file of some length of, and says how many those are: a save that broke off goes on."""
    spark = px.sparkSession
    keys = [name for _, name, _, _ in string.Formatter().parse(template) if name]
    fs, root = place_of(path)
    todo = px
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        done = listed(spark, path, pattern, keys).where("bytes > 0").select(*[F.col(k).cast(px.schema[k].dataType).alias(k) for k in keys])
        todo = px.join(done, keys, "left_anti")
    left = todo.select(*keys).distinct().count()
    if left:
        save_rasters(todo, path, template, value, form)
    return left


def mesh_rows(vertices: DataFrame, faces: DataFrame, planes: DataFrame) -> DataFrame:
    """scene_id, part, at and the fields of a mesh file: header lines, vertices by vid, faces by fid.

    ``planes``: scene_id, plane_id, label_int, label_raw, a, b, c, d, area and red, green, blue; each is a comment line of the header.
    """
    counts = vertices.groupBy("scene_id").agg(F.count("*").alias("nv")).join(faces.groupBy("scene_id").agg(F.count("*").alias("nf")), "scene_id")
    top = F.array(F.lit("ply"), F.lit("format binary_little_endian 1.0"), F.concat(F.lit("element vertex "), F.col("nv").cast("string")), *[F.lit(f"property float {a}") for a in "xyz"], F.concat(F.lit("element face "), F.col("nf").cast("string")), *[F.lit(f"property {p}") for p in ("list uchar int vertex_indices", "int plane_id", "int label_int")])
    none = {"line": "string", "x": "double", "y": "double", "z": "double", **{c: "long" for c in ("v0", "v1", "v2")}, "plane_id": "int", "label_int": "int"}
    shape = lambda df, part, at, **have: df.select("scene_id", F.lit(part).alias("part"), at.cast("long").alias("at"), *[(have[c].cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in none.items()])
    head = counts.select("scene_id", F.posexplode(top).alias("k", "line"))
    named = F.format_string('comment plane_id %d label_int %d label_raw "%s" n %s %s %s d %s area %s color %d %d %d', "plane_id", "label_int", F.regexp_replace("label_raw", "[\r\n]", " "), *[F.col(c).cast("string") for c in ("a", "b", "c", "d", "area")], "red", "green", "blue")
    each = planes.withColumn("_at", F.row_number().over(_by_plane()) + 100)
    last = counts.select("scene_id", F.lit("end_header").alias("line"))
    parts = [shape(head, 0, F.col("k"), line=F.col("line")), shape(each, 0, F.col("_at"), line=named), shape(last, 0, F.lit(1 << 40), line=F.col("line"))]
    parts += [shape(vertices, 1, F.col("vid"), x=F.col("x"), y=F.col("y"), z=F.col("z")), shape(faces, 2, F.col("fid"), **{c: F.col(c) for c in ("v0", "v1", "v2", "plane_id", "label_int")})]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _by_plane():
    from pyspark.sql import Window

    return Window.partitionBy("scene_id").orderBy("plane_id")


def save_meshes(vertices: DataFrame, faces: DataFrame, planes: DataFrame, path: str, template: str = "{scene_id}.ply", mode: str = "append") -> None:
    """A binary PLY for each scene, its planes named in the header; rows are streamed, so a mesh may be larger than a task's memory."""
    register(vertices.sparkSession)
    rows = mesh_rows(vertices, faces, planes).repartition("scene_id").sortWithinPartitions("scene_id", "part", "at")
    rows.write.format("plane_mesh").option("template", template).mode(mode).save(path)


def read_plane_comments(rows: DataFrame) -> DataFrame:
    """The planes named in the headers of meshes (scene_id, content)."""
    head = F.split(F.substring_index(F.decode("content", "ISO-8859-1"), "end_header", 1), "\n")
    line = F.explode(F.filter(head, lambda x: x.startswith("comment plane_id")))
    number = r"(\S+)"
    pattern = rf'^comment plane_id {number} label_int {number} label_raw "(.*)" n {number} {number} {number} d {number} area {number} color {number} {number} {number}$'
    names = [("plane_id", "int"), ("label_int", "int"), ("label_raw", "string"), *[(c, "double") for c in ("a", "b", "c", "d", "area")], *[(c, "int") for c in ("red", "green", "blue")]]
    return rows.select("scene_id", line.alias("_l")).select("scene_id", *[F.regexp_extract("_l", pattern, k + 1).cast(t).alias(c) for k, (c, t) in enumerate(names)])
