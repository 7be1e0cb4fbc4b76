"""Round trips through the sources and sinks, and the streaming forms, checked against the tables they began with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import rollup
from ..session import shared_path
from ..sources import arrays, frames, meshes, texts
from ..streaming import ingest
from ._common import registrar, rounded
from .fixtures import sql, view

QUERIES, query = registrar()

PX, FACES, VERTS = sql("px_grid"), sql("mesh_faces"), sql("mesh_vertices")


@query("s01_signal_frames", f"select scene_id, frame_id, v, u, round(z, 6) as z, round(planarity, 6) as planarity from {PX} p where scene_id in (1, 2, 3, 4)")
def s01(spark, sf):
    at = shared_path(spark, "frames")
    frames.save(frames.packed(view(spark, sf, "px_grid"), ["z", "planarity"]), at)
    return rounded(frames.exploded(frames.read(spark, at, [1, 2, 3, 4]).withColumn("scene_id", F.col("scene_id").cast("bigint")), ["z", "planarity"]))


@query("s01_resume", f"select distinct scene_id, frame_id from {PX} p where scene_id % 2 = 1")
def s01b(spark, sf):
    at = shared_path(spark, "frames")
    packed = frames.packed(view(spark, sf, "px_grid"), ["label"])
    frames.save(packed.where("scene_id % 2 = 0"), at, "label")
    return frames.not_yet(packed, at).select("scene_id", "frame_id")


@query("s14_depth_sink", f"select scene_id, frame_id, v, u, cast(least(greatest(round_even(z * 1000.0, 0), 0), 65535) as int) as mm from {PX} p")
def s14(spark, sf):
    from ..functions import geometry as G

    at = shared_path(spark, "depth")
    frames.save(frames.packed(view(spark, sf, "px_grid").withColumn("mm", G.millimetres("z")), ["mm"]), at)
    return frames.exploded(frames.read(spark, at).withColumn("scene_id", F.col("scene_id").cast("bigint")), ["mm"])


@query("s18_ply_faces", f"select scene_id, fid, v0, v1, v2, plane_id, label_int from {FACES} f")
def s18(spark, sf):
    return meshes.read_faces(meshes.files(view(spark, sf, "mesh_vertices"), view(spark, sf, "mesh_faces")))


@query("s19_ply_vertices", f"select scene_id, vid, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from {VERTS} v")
def s19(spark, sf):
    made = meshes.files(view(spark, sf, "mesh_vertices"), view(spark, sf, "mesh_faces"))
    return rounded(meshes.read_vertices(made), digits=4)


@query("s21_ascii_ply", f"select scene_id, 2 as part, fid as \"at\", concat_ws(' ', '3', v0, v1, v2, plane_id) as line from {FACES} f union all select scene_id, 1, vid, printf('%.6f %.6f %.6f', x, y, z) from {VERTS} v")
def s21(spark, sf):
    return meshes.ascii_lines(view(spark, sf, "mesh_vertices"), view(spark, sf, "mesh_faces")).where("part > 0")


@query("s07_npz_frames", f"select scene_id, frame_id, count(*) as pixels, count(*) filter (label > 0) as planar from {PX} p group by all")
def s07(spark, sf):
    packed = frames.packed(view(spark, sf, "px_grid"), ["z", "label"])

    def archive(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                seg = np.array(r.label).reshape(r.h, r.w)
                yield pd.DataFrame({"path": [f"{r.scene_id}/{r.frame_id}_d2.npz"], "content": [arrays.encode(np.array(r.z).reshape(r.h, r.w), np.where(seg == 0, 20, seg - 1), np.eye(3))]})

    back = arrays.decoded(packed.mapInPandas(archive, "path string, content binary"))
    name = F.split(F.regexp_replace("path", "_d2[.]npz$", ""), "/")
    return back.select(name[0].cast("bigint").alias("scene_id"), name[1].cast("bigint").alias("frame_id"), F.size("label").cast("bigint").alias("pixels"), F.size(F.filter("label", lambda x: x > 0)).cast("bigint").alias("planar"))


@query("s22_segment_labels", "select n_nationkey as scene_id, r.i::int as vid, case r.i % 4 when 1 then 'wall' when 2 then 'floor' else 'unannotated' end as label from nation, (select unnest(range(12)) as i) r")
def s22(spark, sf):
    scenes = view(spark, sf, "nation").select(F.col("n_nationkey").alias("scene_id"))
    seg = scenes.withColumn("segIndices", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i % 4))
    text = '{"segGroups":[{"label":"door","segments":[2]},{"label":"wall","segments":[1]},{"label":"floor","segments":[2]}]}'
    groups = scenes.withColumn("j", F.from_json(F.lit(text), "segGroups array<struct<label: string, segments: array<int>>>")).select("scene_id", "j.segGroups")
    return texts.segment_labels(seg, groups)


@query("s27_extrinsics", "select lpad(cast(p_partkey as varchar), 5, '0') as frame_id, round(p_retailprice, 4) as tx, 1.0::double as last from part where p_partkey % 2 = 0")
def s27(spark, sf):
    at = shared_path(spark, "extrinsic")
    p = view(spark, sf, "part")
    line = F.concat_ws(" ", F.col("p_partkey").cast("string"), (F.col("p_partkey") % 2).cast("string"), F.lit("1 0 0"), F.format_string("%.4f", "p_retailprice"), F.lit("0 1 0 0 0 0 1 0 0 0 0 1"))
    p.select(line.alias("value")).union(spark.createDataFrame([("frame cameraID r1,1",)], "value string")).write.text(at)
    got = texts.extrinsics(spark.read.text(at), 0)
    return rounded(got.select("frame_id", F.get("pose", F.lit(3)).alias("tx"), F.get("pose", F.lit(15)).alias("last")), digits=4)


@query("s28_pose_json", "select cast(n_nationkey as varchar) as frame_id, 40.0::double as fx, 1.5::double * n_nationkey as cx, cast(n_nationkey as double) as tz from nation")
def s28(spark, sf):
    at = shared_path(spark, "poses")
    n = F.col("n_nationkey")
    row = lambda *c: F.array(*[x.cast("double") if hasattr(x, "cast") else F.lit(float(x)) for x in c])
    body = F.map_from_arrays(F.array(n.cast("string")), F.array(F.struct(F.array(row(40, 0, 1.5 * n), row(0, 40, 2), row(0, 0, 1)).alias("intrinsic"), F.array(row(1, 0, 0, 0), row(0, 1, 0, 0), row(0, 0, 1, n), row(0, 0, 0, 1)).alias("aligned_pose"))))
    view(spark, sf, "nation").select(F.to_json(body).alias("value")).write.text(at)
    got = texts.poses(spark.read.text(at))
    return rounded(got.select("frame_id", "fx", "cx", F.get("pose", F.lit(11)).alias("tz")))


@query("s29_result_files", f"select scene_id, count(*) as num_frames, round(avg(m1), 4) as m1 from {sql('metrics_fx')} f group by scene_id")
def s29(spark, sf):
    at = shared_path(spark, "results")
    f = view(spark, sf, "metrics_fx")
    scenes = rollup.by_scene(f, ["m1", "m2"])
    texts.save_results(f, scenes, rollup.dataset(scenes, ["m1", "m2"]), at)
    return rounded(texts.read_results(spark, f"{at}/results_per_scene", "scene_id long, num_frames long, m1 double, m2 double").select("scene_id", "num_frames", "m1"), digits=4)


@query("s35_scene_lists", "select n_name as scene from nation union all select 'extra' union all select 'more'")
def s35(spark, sf):
    at = shared_path(spark, "lists")
    names = view(spark, sf, "nation").select(F.col("n_name").alias("value"))
    names.union(spark.createDataFrame([("# a comment",), ("",), (" extra , more",)], "value string")).write.text(at)
    return texts.scene_list(spark.read.text(at))


@query("st01_stream_contingency", f"select scene_id, frame_id, gt, pred, count(*) as n from {sql('px_seg')} p group by all")
def st01(spark, sf):
    source, table, state = (shared_path(spark, n) for n in ("landed", "changes", "state"))
    view(spark, sf, "px_seg").repartition(6).write.parquet(source)
    stream = ingest.contingency_stream(spark, source, "scene_id long, frame_id long, gt int, pred int", 2)
    ingest.run_available(stream, table, state)
    return ingest.newest(spark, table, ["scene_id", "frame_id", "gt", "pred"], "n")


@query("st02_event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all")
def st02(spark, sf):
    return ingest.windowed(view(spark, sf, "events"), "ts", "1 hour", "10 minutes", ["event_type"])
