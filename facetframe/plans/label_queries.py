"""Queries over label rasters: metrics, relabelling, votes, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, labels, metrics, rollup
from ._common import registrar, rounded
from .fixtures import sql, view

QUERIES, query = registrar()

PX = sql("px_seg")
_CON = f"con as (select scene_id, frame_id, gt, pred, count(*) as n from {PX} p group by all)"
_MAR = f"{_CON}, mar as (select *, sum(n) over (partition by scene_id, frame_id, gt) as r, sum(n) over (partition by scene_id, frame_id, pred) as c, sum(n) over (partition by scene_id, frame_id) as t from con)"
_SC = f"{_MAR}, best as (select scene_id, frame_id, gt, max(r) as area, max(n::double / (r + c - n)) as iou from mar group by all), sc as (select scene_id, frame_id, sum(area * iou) / sum(area) as sc from best group by all)"
_CL = "cl as (select scene_id, frame_id, case when max(t)::double * max(t) - max(t) = 0 then 1 else (max(t)::double * max(t) + 2 * sum(n::double * n) - sum(n::double * r) - sum(n::double * c) - max(t)) / (max(t)::double * max(t) - max(t)) end as rand_index, abs(sum(n::double / t * (log2(n::double / r) + log2(n::double / c)))) as voi from mar group by all)"
_BP = f"cnt as (select scene_id, frame_id, count(*) filter (gt <> 0 and pred <> 0)::double as tp, count(*) filter (gt = 0 and pred <> 0)::double as fp, count(*) filter (gt <> 0 and pred = 0)::double as fn, count(*) filter (gt = 0 and pred = 0)::double as tn from {PX} p group by all), pr as (select *, tp / greatest(tp + fp, 1) as p, tp / greatest(tp + fn, 1) as q from cnt), bp as (select scene_id, frame_id, (tp + tn) / greatest(tp + fp + fn + tn, 1) as bp_accuracy, p as bp_precision, q as bp_recall, 2 * p * q / greatest(p + q, 1e-8) as bp_f1, tp / greatest(tp + fp + fn, 1) as bp_iou from pr)"


@query("a01_contingency", f"with {_CON} select scene_id, frame_id, gt, pred, n from con")
def a01(spark, sf):
    return metrics.contingency(view(spark, sf, "px_seg"))


@query("a02_segmentation_covering", f"with {_SC}, s as (select scene_id, avg(sc) as sc, count(*) as num_frames from sc group by all) select scene_id, round(sc, 6) as sc, num_frames, round(avg(sc) over (), 6) as dataset_sc from s")
def a02(spark, sf):
    scenes = rollup.by_scene(metrics.segmentation_covering(view(spark, sf, "px_seg")), ["sc"])
    whole = rollup.dataset(scenes, ["sc"]).select(F.col("sc_mean").alias("dataset_sc"))
    return rounded(scenes.crossJoin(F.broadcast(whole)).select("scene_id", "sc", "num_frames", "dataset_sc"))


@query("a03_rand_voi", f"with {_MAR}, {_CL} select scene_id, frame_id, round(rand_index, 6) as rand_index, round(voi, 6) as voi from cl")
def a03(spark, sf):
    return rounded(metrics.clustering(view(spark, sf, "px_seg")))


@query("a04_binary_planarity", f"with {_BP} select scene_id, frame_id, round(bp_accuracy, 6) as bp_accuracy, round(bp_precision, 6) as bp_precision, round(bp_recall, 6) as bp_recall, round(bp_f1, 6) as bp_f1, round(bp_iou, 6) as bp_iou from bp")
def a04(spark, sf):
    return rounded(metrics.binary_planarity(view(spark, sf, "px_seg")))


@query("a10_frame_metrics", f"with {_SC}, {_CL}, {_BP} select scene_id, frame_id, round(sc, 6) as sc, round(rand_index, 6) as rand_index, round(voi, 6) as voi, round(bp_accuracy, 6) as bp_accuracy, round(bp_precision, 6) as bp_precision, round(bp_recall, 6) as bp_recall, round(bp_f1, 6) as bp_f1, round(bp_iou, 6) as bp_iou from sc join cl using (scene_id, frame_id) join bp using (scene_id, frame_id)")
def a10(spark, sf):
    return rounded(metrics.frame_metrics(view(spark, sf, "px_seg")))


def _methods(px):
    """Three methods over one ground truth: as predicted, the ground truth itself, and a constant."""
    one = lambda m, c: px.select(F.lit(m).alias("method"), "scene_id", "frame_id", "gt", c.cast("int").alias("pred"))
    return one("own", F.col("pred")).union(one("gt", F.col("gt"))).union(one("flat", F.lit(1)))


@query("a11_method_benchmark", f"with m as (select 'own' as method, * from {PX} p union all select 'gt', scene_id, frame_id, gt, gt from {PX} p union all select 'flat', scene_id, frame_id, gt, 1 from {PX} p), con as (select method, scene_id, frame_id, gt, pred, count(*) as n from m group by all), mar as (select *, sum(n) over (partition by method, scene_id, frame_id, gt) as r, sum(n) over (partition by method, scene_id, frame_id, pred) as c from con), best as (select method, scene_id, frame_id, gt, max(r) as area, max(n::double / (r + c - n)) as iou from mar group by all), sc as (select method, scene_id, frame_id, sum(area * iou) / sum(area) as sc from best group by all), s as (select method, scene_id, avg(sc) as sc from sc group by all) select method, count(*) as num_scenes, round(avg(sc), 6) as sc_mean from s group by method")
def a11(spark, sf):
    px = _methods(view(spark, sf, "px_seg")).withColumn("frame_id", F.struct("method", "frame_id"))
    sc = metrics.segmentation_covering(px).select(F.col("frame_id.method").alias("method"), "scene_id", "sc")
    return rounded(sc.groupBy("method", "scene_id").agg(F.avg("sc").alias("sc")).groupBy("method").agg(F.count("*").alias("num_scenes"), F.avg("sc").alias("sc_mean")))


@query("a12_scene_rollup", f"select scene_id, count(*) as num_frames, round(avg(m1), 6) as m1, round(avg(m2), 6) as m2 from {sql('metrics_fx')} f group by scene_id")
def a12(spark, sf):
    return rounded(rollup.by_scene(view(spark, sf, "metrics_fx"), ["m1", "m2"]))


@query("a13_dataset_rollup", f"with s as (select scene_id, count(*) as num_frames, avg(m1) as m1, avg(m2) as m2 from {sql('metrics_fx')} f group by scene_id) select count(*) as num_scenes, sum(num_frames)::bigint as num_frames_total, round(avg(m1), 4) as m1_mean, round(stddev_samp(m1), 4) as m1_std, round(avg(m2), 4) as m2_mean, round(stddev_samp(m2), 4) as m2_std from s")
def a13(spark, sf):
    scenes = rollup.by_scene(view(spark, sf, "metrics_fx"), ["m1", "m2"])
    return rounded(rollup.dataset(scenes, ["m1", "m2"]), digits=4)


@query("a16_majority_vote", f"with c as (select scene_id, frame_id, pred, gt, count(*) as votes from {PX} p group by all), w as (select *, row_number() over (partition by scene_id, frame_id, pred order by votes desc, gt) as rn from c) select scene_id, frame_id, pred, gt as label, votes from w where rn = 1")
def a16(spark, sf):
    return labels.vote(view(spark, sf, "px_seg"), ["scene_id", "frame_id", "pred"], "gt")


@query("a21_summary_f1", f"with s as (select cast(scene_id % 3 as bigint) as method, avg(m1) / 500000 as p, avg(m2) / 500000 as r from {sql('metrics_fx')} f group by scene_id), m as (select method, avg(p) as p, avg(r) as r from s group by method) select method, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from m")
def a21(spark, sf):
    scenes = rollup.by_scene(view(spark, sf, "metrics_fx"), ["m1", "m2"])
    named = scenes.select((F.col("scene_id") % 3).alias("method"), (F.col("m1") / 500000).alias("p"), (F.col("m2") / 500000).alias("r"))
    return rounded(rollup.precision_recall_f1(named, "p", "r"))


@query("a22_stage_timers", "select event_type as stage, round(sum(value), 4) as seconds, count(*) as calls, round(1000 * sum(value) / count(*), 4) as avg_ms from events group by event_type")
def a22(spark, sf):
    return rounded(rollup.timers(view(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))), digits=4)


@query("a23_depth_losses", f"with g as (select *, label > 0 and z > 0 as planar, label > 0 and z > 0 and not (z > 2.1 and z < 3.2) as lost from {sql('px_grid')} p) select scene_id, count(*) filter (planar) as planar, count(*) filter (lost) as lost, round(max(z) filter (planar), 6) as max_depth, count(distinct frame_id) as frames, round(count(*) filter (lost)::double / greatest(count(*) filter (planar), 1), 6) as lost_share from g group by scene_id")
def a23(spark, sf):
    return rounded(rollup.depth_losses(view(spark, sf, "px_grid"), 2.1, 3.2))


@query("f19_clock", "select event_id, lpad(cast(cast(floor(floor(value * 1000) / 3600000) as bigint) as varchar), 2, '0') || ':' || lpad(cast(cast(floor(floor(value * 1000) / 60000) as bigint) % 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(floor(value * 1000) / 1000) as bigint) % 60 as varchar), 2, '0') || '.' || lpad(cast(cast(floor(value * 1000) as bigint) % 1000 as varchar), 3, '0') as clock from events where value >= 0")
def f19(spark, sf):
    return view(spark, sf, "events").where("value >= 0").select("event_id", rollup.clock("value").alias("clock"))


@query("p04_filter_small_segments", f"with s as (select scene_id, frame_id, pred, count(*) as size from {PX} p where pred > 0 group by all having count(*) >= 110), r as (select *, row_number() over (partition by scene_id, frame_id order by pred) as kept_label from s) select p.scene_id, p.frame_id, coalesce(r.kept_label, 0)::int as kept_label, count(*) as n from {PX} p left join r on p.scene_id = r.scene_id and p.frame_id = r.frame_id and p.pred = r.pred group by all")
def p04(spark, sf):
    return labels.drop_small(view(spark, sf, "px_seg"), 110).groupBy("scene_id", "frame_id", "kept_label").agg(F.count("*").alias("n"))


@query("p13_label_shift", f"select scene_id, frame_id, pred, case when pred - 1 < 0 then 0 else pred end as shifted, count(*) as n from {PX} p group by all")
def p13(spark, sf):
    px = view(spark, sf, "px_seg").withColumn("mesh", F.col("pred") - 1)
    return px.withColumn("shifted", labels.shift("mesh")).groupBy("scene_id", "frame_id", "pred", "shifted").agg(F.count("*").alias("n"))


@query("p14_legacy_shift", f"select scene_id, frame_id, greatest(pred - 1, 0) as shifted, count(*) as n from {PX} p group by all")
def p14(spark, sf):
    px = view(spark, sf, "px_seg").withColumn("mesh", F.col("pred") - 1)
    return px.withColumn("shifted", labels.legacy_shift("mesh")).groupBy("scene_id", "frame_id", "shifted").agg(F.count("*").alias("n"))


@query("p15_nonplanar_remap", f"select pred, case when pred = 4 then 0 else pred + 1 end as indoor, case when pred = 4 then 0 else pred end as outdoor, count(*) as n from {PX} p group by all")
def p15(spark, sf):
    px = view(spark, sf, "px_seg").withColumns({"indoor": labels.nonplanar_to_zero("pred", 4, True), "outdoor": labels.nonplanar_to_zero("pred", 4, False)})
    return px.groupBy("pred", "indoor", "outdoor").agg(F.count("*").alias("n"))


@query("p16_npz_remap", "select cast(case when l_partkey % 21 = 20 then 0 else l_partkey % 21 + 1 end as bigint) as label, count(*) as n from lineitem group by 1")
def p16(spark, sf):
    rows = view(spark, sf, "lineitem").withColumn("seg", F.col("l_partkey") % 21)
    return rows.select(labels.nonplanar_to_zero("seg", 20, True).cast("bigint").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("p17_two_stage_remap", "with t as (select r_name as name, cast(r_regionkey + 10 as bigint) as target from region where r_regionkey <> 1) select c_custkey, coalesce(t.target, 0) as target from customer left join (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey) n on c_nationkey = n.n_nationkey left join t on n.r_name = t.name")
def p17(spark, sf):
    nation, region = view(spark, sf, "nation"), view(spark, sf, "region")
    names = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("name"))
    targets = region.where("r_regionkey <> 1").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 10).cast("bigint").alias("target"))
    return labels.two_stage(view(spark, sf, "customer"), "c_nationkey", names, targets).select("c_custkey", F.col("target").cast("bigint").alias("target"))


@query("p18_class_merge", "select a.n_nationkey as a, b.n_nationkey as b, (a.n_regionkey = b.n_regionkey or (a.n_regionkey in (0, 2) and b.n_regionkey in (0, 2)) or (a.n_regionkey in (3, 4) and b.n_regionkey in (3, 4))) as ok from nation a join nation b on a.n_nationkey < b.n_nationkey")
def p18(spark, sf):
    n = view(spark, sf, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(f"r{k}")) for k in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", labels.can_merge("ra", "rb", [[0, 2], [3, 4]]).alias("ok"))


@query("p19_name_resolver", "with tk as (select unnest(['3', 'brazil', 'IND', 'zzz', '999']) as token), pairs as (select token, n_nationkey as id, case when regexp_matches(token, '^[0-9]+$') and try_cast(token as bigint) = n_nationkey then 1 when lower(token) = lower(n_name) then 2 when contains(lower(n_name), lower(token)) then 3 end as kind from tk, nation), best as (select *, min(kind) over (partition by token) as b from pairs where kind is not null) select tk.token, cast(best.id as bigint) as id, best.kind from tk left join best on tk.token = best.token and best.kind = best.b where best.token is null or best.kind = best.b")
def p19(spark, sf):
    tokens = spark.createDataFrame([(t,) for t in ("3", "brazil", "IND", "zzz", "999")], "token string")
    names = view(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return labels.resolve_names(tokens, names).select("token", F.col("id").cast("bigint").alias("id"), "kind")


@query("p20_planar_classes", f"select scene_id, gt, count(*) as n from {PX} p where gt in (1, 2) and not (scene_id = 3 and gt = 1) group by all")
def p20(spark, sf):
    px = view(spark, sf, "px_seg").where(F.col("gt").isin(1, 2) & ~((F.col("scene_id") == 3) & (F.col("gt") == 1)))
    return px.groupBy("scene_id", "gt").agg(F.count("*").alias("n"))


@query("p28_last_channel", "select l_orderkey, coalesce(max(case when l_quantity > 25 then l_linenumber + 1 end), 0)::int as instance from lineitem group by 1")
def p28(spark, sf):
    rows = view(spark, sf, "lineitem").withColumn("on", (F.col("l_quantity") > 25).cast("int"))
    return labels.last_channel(rows, ["l_orderkey"], "l_linenumber", "on").select("l_orderkey", F.col("instance").cast("int").alias("instance"))


@query("t01_top_segments", f"with s as (select scene_id, frame_id, pred, count(*) as size from {PX} p where pred > 0 group by all), r as (select *, row_number() over (partition by scene_id, frame_id order by size desc, pred) as rank from s) select scene_id, frame_id, pred, size, rank::int as rank from r where rank <= 2")
def t01(spark, sf):
    return labels.top_segments(view(spark, sf, "px_seg"), 2)


@query("t03_keep_top", f"with s as (select scene_id, frame_id, pred, count(*) as size from {PX} p where pred > 0 group by all), r as (select *, row_number() over (partition by scene_id, frame_id order by size desc, pred) as rank from s) select p.scene_id, p.frame_id, coalesce(r.pred, 0) as top_label, count(*) as n from {PX} p left join r on p.scene_id = r.scene_id and p.frame_id = r.frame_id and p.pred = r.pred and r.rank <= 2 group by all")
def t03(spark, sf):
    return labels.keep_top(view(spark, sf, "px_seg"), 2).groupBy("scene_id", "frame_id", "top_label").agg(F.count("*").alias("n"))


@query("w06_dense_relabel", f"select scene_id, frame_id, pred, case when pred > 0 then dense_rank() over (partition by scene_id, frame_id, pred > 0 order by pred) else 0 end::int as dense, n from (select scene_id, frame_id, pred, count(*) as n from {PX} p group by all) c")
def w06(spark, sf):
    return labels.dense(view(spark, sf, "px_seg")).groupBy("scene_id", "frame_id", "pred", "dense").agg(F.count("*").alias("n"))


@query("j11_colour_legend", "select l_orderkey, l_linenumber, coalesce(p.id, -1) as id from lineitem left join (select cast(p_partkey % 256 as int) as r, cast(p_partkey // 256 % 256 as int) as g, p_partkey as id from part where p_size < 30) p on l_partkey % 256 = p.r and l_partkey // 256 % 256 = p.g")
def j11(spark, sf):
    at = lambda c: [(F.col(c) % 256).cast("int").alias("r"), (F.floor(F.col(c) / 256) % 256).cast("int").alias("g"), F.lit(7).alias("b")]
    legend = view(spark, sf, "part").where("p_size < 30").select(*at("p_partkey"), F.col("p_partkey").alias("id"))
    rows = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *at("l_partkey"))
    return labels.packed_legend(rows, legend).select("l_orderkey", "l_linenumber", "id")


@query("j25_mapped_default", "select c_custkey, coalesce(n.n_name, 'none') as mapped from customer left join (select * from nation where n_regionkey < 3) n on c_nationkey = n_nationkey")
def j25(spark, sf):
    return labels.mapped(view(spark, sf, "customer"), "c_nationkey", view(spark, sf, "nation").where("n_regionkey < 3"), "n_nationkey", "n_name", "none").select("c_custkey", "mapped")


@query("j20_overlap_match", f"with c as (select scene_id, frame_id, gt, pred, count(*) as n from {PX} p where gt > 0 and pred > 0 group by all), w as (select *, row_number() over (partition by scene_id, frame_id, gt order by n desc, pred) as rn from c) select scene_id, frame_id, gt, pred as match, n as pixels from w where rn = 1 and n >= 10")
def j20(spark, sf):
    return joins.overlap_match(view(spark, sf, "px_seg"), "gt", "pred", 10, ["scene_id", "frame_id"])


@query("u01_union_ids", "select distinct id from (select l_partkey as id from lineitem where l_quantity < 5 union all select l_suppkey from lineitem where l_quantity > 45) t")
def u01(spark, sf):
    rows = view(spark, sf, "lineitem")
    return rows.where("l_quantity < 5").select(F.col("l_partkey").alias("id")).union(rows.where("l_quantity > 45").select("l_suppkey")).distinct()


@query("u02_shard_concat", f"with m as (select *, 0 as shard from {sql('metrics_fx')} a union all select scene_id, frame_id, n, m1 + 1, m2, 1 from {sql('metrics_fx')} b where n > 10) select scene_id, frame_id, n, round(arg_max(m1, shard), 4) as m1 from m group by scene_id, frame_id, n")
def u02(spark, sf):
    f = view(spark, sf, "metrics_fx").withColumn("shard", F.lit(0))
    more = f.where("n > 10").withColumns({"m1": F.col("m1") + 1, "shard": F.lit(1)})
    return rounded(rollup.latest(f.unionByName(more), ["scene_id", "frame_id"], "shard").select("scene_id", "frame_id", "n", "m1"), digits=4)


@query("u03_leftover_ids", "select distinct p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def u03(spark, sf):
    used = view(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return view(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti").distinct()


@query("u04_best_cluster", f"with i as (select o.plane_id, o.seq, count(*) as hits from {sql('outlines')} o where o.area > 20 group by all), w as (select *, row_number() over (partition by plane_id order by hits desc, seq) as rn from i) select plane_id, seq as cluster, hits from w where rn = 1")
def u04(spark, sf):
    hits = view(spark, sf, "outlines").where("area > 20").groupBy("plane_id", "seq").agg(F.count("*").alias("hits"))
    return hits.groupBy("plane_id").agg(F.max_by("seq", F.struct("hits", -F.col("seq"))).alias("cluster"), F.max("hits").alias("hits"))


@query("u05_policy_conflict", "select n_nationkey from nation where n_regionkey < 3 intersect select n_nationkey from nation where n_nationkey % 2 = 0")
def u05(spark, sf):
    n = view(spark, sf, "nation")
    return n.where("n_regionkey < 3").select("n_nationkey").intersect(n.where("n_nationkey % 2 = 0").select("n_nationkey"))


@query("u06_split_disjoint", "select count(*) as shared from (select c_custkey from customer where c_custkey % 10 < 7 intersect select c_custkey from customer where c_custkey % 10 >= 6) t")
def u06(spark, sf):
    c = view(spark, sf, "customer")
    return c.where("c_custkey % 10 < 7").select("c_custkey").intersect(c.where("c_custkey % 10 >= 6").select("c_custkey")).agg(F.count("*").alias("shared"))
