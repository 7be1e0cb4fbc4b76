"""File sinks with a commit, shard manifests, stage timers, area resize, discovery and resumed saves."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from facetframe.operators import stencil, timing
from facetframe.sources import meshes, shards, sinks

PIXELS = "scene_id long, frame_id long, v int, u int, label int"


def files(at):
    return sorted(os.path.relpath(os.path.join(d, f), at) for d, _, fs in os.walk(at) for f in fs)


@pytest.fixture(scope="module")
def px(spark):
    rows = [(s, f, v, u, (s * 7001 + f * 977 + v * 31 + u * 3) % 70000 - 20) for s in (1, 2) for f in range(5) for v in range(6) for u in range(4 + s)]
    return spark.createDataFrame(rows, PIXELS).repartition(3).cache()


def test_png_read_back(spark, px, tmp_path):
    at = str(tmp_path / "labels")
    sinks.save_rasters(px, at)
    assert files(at) == [f"{s}/{f}.png" for s in (1, 2) for f in range(5)]
    got = sinks.read_rasters(spark, at, r"/(\d+)/(\d+)[.]png$", ["scene_id", "frame_id"])
    rows = lambda df: sorted(tuple(int(x) for x in r) for r in df.collect())
    assert rows(got) == rows(px.withColumn("label", F.greatest(F.lit(0), F.least(F.lit(65535), "label"))))


def test_png_filters():
    """Lines under every filter, for 8 and 16 bits, against what they encode."""
    r = np.random.default_rng(1)
    for step, most in ((1, 256), (2, 65536)):
        raster = r.integers(0, most, (5, 7))
        raw = raster.astype(">u2" if step == 2 else "u1").view(np.uint8).reshape(5, -1).astype(int)
        lines = b""
        for v, kind in enumerate((0, 1, 2, 3, 4)):
            up = raw[v - 1] if v else np.zeros(raw.shape[1], int)
            line = [kind]
            for k, x in enumerate(raw[v]):
                a, b, c = (raw[v][k - step] if k >= step else 0), up[k], (up[k - step] if k >= step else 0)
                paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
            lines += bytes(line)
        head = sinks.struct.pack(">IIBBBBB", 7, 5, 8 * step, 0, 0, 0, 0)
        png = b"\x89PNG\r\n\x1a\n" + sinks._chunk(b"IHDR", head) + sinks._chunk(b"IDAT", zlib.compress(lines)) + sinks._chunk(b"IEND", b"")
        assert (sinks.decode_png(png) == raster).all()
    with pytest.raises(ValueError):
        sinks.decode_png(png[:-20] + b"x" + png[-19:])


def test_repeated_attempts_leave_one_file(px, tmp_path):
    """Only what is committed counts: a second attempt of a task, a task that fails and an aborted job leave nothing."""
    at = str(tmp_path / "out")
    os.makedirs(at)
    batches = px.where("scene_id = 1").orderBy("frame_id", "v", "u").toArrow().to_batches(max_chunksize=7)
    writer = sinks.RasterWriter({"path": at, "template": "{scene_id}/{frame_id}.png"}, False, sinks.encode_png)
    first, second = writer.write(iter(batches)), writer.write(iter(batches))
    assert len(first.files) == len(second.files) == 5
    writer.commit([second, None])
    assert files(at) == [f"1/{f}.png" for f in range(5)]
    again = sinks.RasterWriter({"path": at, "template": "{scene_id}/{frame_id}.png"}, False, sinks.encode_png)
    again.write(iter(batches))
    again.abort([])
    assert files(at) == [f"1/{f}.png" for f in range(5)]
    split = sinks.RasterWriter({"path": at, "template": "{scene_id}/{frame_id}.png"}, False, sinks.encode_png)
    with pytest.raises(ValueError):
        split.commit([split.write(iter(batches)), split.write(iter(batches))])
    assert files(at) == [f"1/{f}.png" for f in range(5)]


def test_failed_job_leaves_nothing(spark, px, tmp_path):
    at = str(tmp_path / "failed")
    bad = px.withColumn("label", F.when(F.col("frame_id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("label")).cast("int"))
    with pytest.raises(Exception, match="no"):
        sinks.save_rasters(bad, at)
    assert not os.path.exists(at) or files(at) == []


def test_overwrite_replaces(px, tmp_path):
    at = str(tmp_path / "again")
    sinks.save_rasters(px, at)
    sinks.save_rasters(px.where("scene_id = 2"), at, mode="overwrite")
    assert files(at) == [f"2/{f}.png" for f in range(5)]


def test_remap_counts_unmapped(spark, px):
    table = spark.createDataFrame([(k, k % 50 + 1) for k in range(0, 70000, 2)], "old int, new int")
    told = Observation()
    got = sinks.remapped(px, "label", table, "old", "new", told).collect()
    odd = sum(r.label % 2 == 1 or r.label < 0 for r in px.collect())
    assert told.get == {"pixels": len(got), "unmapped": odd} and sum(r.label == 0 for r in got) == odd


def test_plane_mesh(spark, tmp_path):
    v = spark.createDataFrame([(s, k, 0.5 * k, 1.0 * k, -0.25 * k * s) for s in (1, 2) for k in range(4 + s)], "scene_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(s, k, k, k + 1, k + 2, k % 2 - 1, 7) for s in (1, 2) for k in range(2 + s)], "scene_id long, fid long, v0 long, v1 long, v2 long, plane_id int, label_int int")
    p = spark.createDataFrame([(s, k, 7, 'a "wall"', 0.0, 0.6, 0.8, 1.25, 2.5, 1, 2, 250) for s in (1, 2) for k in (0, 3)], "scene_id long, plane_id int, label_int int, label_raw string, a double, b double, c double, d double, area double, red int, green int, blue int")
    at = str(tmp_path / "mesh")
    sinks.save_meshes(v, f, p, at)
    assert files(at) == ["1.ply", "2.ply"]
    raw = meshes.from_folder(spark, at)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(meshes.read_faces(raw)) == rows(f) and rows(meshes.read_vertices(raw)) == rows(v)
    assert rows(sinks.read_plane_comments(raw)) == rows(p)


def test_npy_and_resumed_save(spark, px, tmp_path):
    """A camera whose save broke off is found by its files and completed; what is there is not written again."""
    at, template, pattern = str(tmp_path / "depth"), "scene_{scene_id}/cam_{cam}/{frame_id}.npy", r"/scene_(\d+)/cam_(\w+)/(\d+)[.]npy$"
    depth = px.withColumns({"cam": F.when(F.col("frame_id") < 3, "a").otherwise("b"), "z": F.col("label") / 10}).drop("label")
    assert sinks.save_missing(depth, at, template, pattern, "z") == 10
    kept = {f: os.stat(os.path.join(at, f)).st_mtime_ns for f in files(at)}
    lost = ["scene_1/cam_b/3.npy", "scene_2/cam_a/1.npy"]
    os.remove(os.path.join(at, lost[0]))
    open(os.path.join(at, lost[1]), "wb").close()
    assert sinks.save_missing(depth, at, template, pattern, "z") == 2 and sinks.save_missing(depth, at, template, pattern, "z") == 0
    assert all(os.stat(os.path.join(at, f)).st_mtime_ns == t for f, t in kept.items() if f not in lost) and files(at) == sorted(kept)
    got = {(int(r.scene_id), int(r.frame_id), r.v, r.u): r.z for r in sinks.read_rasters(spark, at, pattern, ["scene_id", "cam", "frame_id"], "z").collect()}
    assert got == {(r.scene_id, r.frame_id, r.v, r.u): r.z for r in depth.collect()}


def test_discovery_lists_whole_frames(spark, tmp_path):
    for kind, frames in (("rgb", (1, 2, 3)), ("depth", (1, 2)), ("planes", (1, 3, 2))):
        for k in frames:
            at = tmp_path / "scene_4" / kind
            at.mkdir(parents=True, exist_ok=True)
            (at / f"{k:05d}.bin").write_bytes(b"" if (kind, k) == ("planes", 2) else b"x")
    found = sinks.listed(spark, str(tmp_path), r"/scene_(\d+)/(\w+)/(\d+)[.]bin$", ["scene", "kind", "frame"], "*.bin")
    assert found.count() == 7
    assert [tuple(r) for r in sinks.whole_frames(found, ["scene", "frame"], ["rgb", "depth", "planes"]).collect()] == [("4", "00001")]


def test_shards_are_guarded(spark, tmp_path):
    at = str(tmp_path / "run")
    rows = lambda k: spark.createDataFrame([(k, 1.0 * k), (9, 10.0 + k)], "frame_id int, m double")
    for k in (0, 2):
        shards.save_shard(rows(k), at, "r1", k, 3)
    with pytest.raises(ValueError, match=r"\[1\].*missing"):
        shards.read_run(spark, at, "r1")
    with pytest.raises(ValueError, match="no shard"):
        shards.read_run(spark, at, "r2")
    rows(7).write.parquet(f"{at}/rows/broken_off")  # an attempt that never got its entry
    shards.save_shard(rows(5), at, "r0", 0, 3)  # left by an older run
    shards.save_shard(rows(1), at, "r1", 1, 3)
    assert sorted(r.shard for r in shards.read_run(spark, at, "r1").collect()) == [0, 0, 1, 1, 2, 2]
    assert {r.frame_id: r.m for r in shards.merged_run(spark, at, "r1", ["frame_id"]).collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 9: 12.0}
    assert [r.run for r in shards.stale(spark, at, "r1").collect()] == ["r0"]
    shards.save_shard(rows(1), at, "r1", 1, 3)
    with pytest.raises(ValueError, match=r"\[1\].*twice"):
        shards.read_run(spark, at, "r1")
    shards.save_shard(rows(1), at, "r3", 0, 2)
    shards.save_shard(rows(1), at, "r3", 1, 3)
    with pytest.raises(ValueError, match="disagree"):
        shards.read_run(spark, at, "r3")
    with pytest.raises(ValueError):
        shards.save_shard(rows(1), at, "r3", 3, 3)


def test_shard_that_lost_rows(spark, tmp_path):
    at = str(tmp_path / "run")
    attempt = shards.save_shard(spark.range(10), at, "r", 0, 1)
    spark.range(2).write.mode("overwrite").parquet(f"{at}/rows/{attempt}")
    with pytest.raises(ValueError, match="entries"):
        shards.read_run(spark, at, "r")


def test_stages_observe_their_queries(spark, tmp_path):
    at = str(tmp_path / "runtimes")
    for run, n in (("a", 100), ("b", 50)):
        stages = timing.Stages(spark, run)
        for k in range(2):
            with stages.stage("read") as watched:
                watched(spark.range(n * (k + 1))).write.format("noop").mode("overwrite").save()
        with stages.stage("join") as watched:
            watched(spark.range(n).join(spark.range(n // 2), "id")).collect()
        told = {r.stage: (r.calls, r.rows) for r in stages.breakdown().collect()}
        assert told == {"read": (2, 3 * n), "join": (1, n // 2)} and all(r.seconds > 0 for r in stages.table().collect())
        stages.append(at)
        stages.append(at)
    assert timing.read(spark, at).count() == 6 and {r.run for r in timing.read(spark, at).collect()} == {"a", "b"}


def test_area_resize(spark):
    r = np.random.default_rng(3)
    raster = r.normal(size=(7, 9))
    px = spark.createDataFrame([(1, 1, v, u, float(raster[v, u])) for v in range(7) for u in range(9)], "scene_id long, frame_id long, v int, u int, z double")
    for h, w in ((3, 4), (7, 9), (1, 1), (10, 5)):
        got = np.zeros((h, w))
        for p in stencil.area_resize(px, 7, 9, h, w, "z").collect():
            got[p.v, p.u] = p.z
        fine = np.kron(raster, np.ones((h, w))).reshape(h, 7, w, 9).mean(axis=(1, 3))
        assert np.allclose(got, fine) and np.isclose(got.mean(), raster.mean())


def test_empty_tables(spark, px, tmp_path):
    at = str(tmp_path / "none")
    sinks.save_rasters(px.limit(0), at)
    assert not os.path.exists(at) or files(at) == []
