"""Queries over keys, lists, shards and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import joins, sampling
from ._common import registrar, rounded
from .fixtures import sql, view

QUERIES, query = registrar()

KEYS = sql("keys_fx")
HASH = "md5('{seed}:' || cast({key} as varchar))"


@query("j01_frame_join", f"select g.scene_id, g.frame_id, p.frame_id is not null as found from {sql('metrics_fx')} g left join (select distinct scene_id, frame_id from {sql('metrics_fx')} x where n > 12) p on g.scene_id = p.scene_id and g.frame_id = p.frame_id")
def j01(spark, sf):
    f = view(spark, sf, "metrics_fx")
    return joins.matched(f.select("scene_id", "frame_id"), f.where("n > 12"), ["scene_id", "frame_id"])


_STRIP = "regexp_replace({0}, '^0+(.)', '\\1')"


@query("j02_prioritised_keys", f"""with k as (select * from {KEYS} x), p as (select * from k),
    a as (select pred_key as k, min(pred_key) as m from p where pred_key is not null group by 1), b as (select {_STRIP.format('pred_key')} as k, min(pred_key) as m from p where pred_key is not null group by 1),
    d as (select try_cast(pred_key as bigint) as k, min(pred_key) as m from p where try_cast(pred_key as bigint) is not null group by 1), o as (select frame_ord as k, min(pred_key) as m from p group by 1)
    select k.frame_ord, k.gt_key, coalesce(a.m, b.m, f.m, d.m, o.m) as match, case when a.m is not null then 0 when b.m is not null then 1 when f.m is not null then 2 when d.m is not null then 3 when o.m is not null then 4 end as rule
    from k left join a on k.gt_key = a.k left join b on {_STRIP.format('k.gt_key')} = b.k left join a f on 'frame_' || k.gt_key = f.k left join d on try_cast(k.gt_key as bigint) = d.k left join o on k.frame_ord = o.k""")
def j02(spark, sf):
    k = view(spark, sf, "keys_fx")
    return joins.prioritised(k.select("frame_ord", "gt_key"), k.select("frame_ord", "pred_key"))


@query("j03_prefix_lookup", f"with k as (select * from {KEYS} x) select a.gt_key, b.pred_key as match from k a join k b on b.pred_key = 'frame_' || a.gt_key")
def j03(spark, sf):
    k = view(spark, sf, "keys_fx")
    got = joins.prioritised(k.select("gt_key"), k.select("pred_key"), ordinal=None)
    return got.where("rule = 2").select("gt_key", "match")


@query("j04_pose_join", "select l_orderkey, l_linenumber, p_name from lineitem join (select * from part where p_size > 10) p on l_partkey = p_partkey where l_quantity > 30")
def j04(spark, sf):
    rows, poses = view(spark, sf, "lineitem").where("l_quantity > 30"), view(spark, sf, "part").where("p_size > 10")
    return rows.join(poses, rows["l_partkey"] == poses["p_partkey"]).select("l_orderkey", "l_linenumber", "p_name")


@query("j05_complete_frames", "select l_orderkey from lineitem where l_linenumber in (1, 2, 3) group by 1 having count(distinct l_linenumber) = 3")
def j05(spark, sf):
    return joins.complete(view(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", [1, 2, 3])


@query("j06_outstanding_scenes", "select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'F') then 'done' when c_custkey in (select o_custkey from orders) then 'incomplete' else 'missing' end as status from customer")
def j06(spark, sf):
    o = view(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.status(view(spark, sf, "customer").select("c_custkey"), o, o.where("o_orderstatus = 'F'"), "c_custkey")


@query("j06_left_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 3 = 0)")
def j06b(spark, sf):
    return joins.outstanding(view(spark, sf, "customer").select("c_custkey"), view(spark, sf, "orders").where("o_orderkey % 3 = 0").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("j07_same_frame_lists", "with a as (select o_custkey as scene, list(o_orderkey order by o_orderkey) as l from orders group by 1), b as (select o_custkey as scene, list(o_orderkey order by o_orderkey) as l from orders where o_totalprice > 20000 group by 1) select a.scene, a.l is not distinct from b.l as same from a left join b using (scene)")
def j07(spark, sf):
    o = view(spark, sf, "orders").select(F.col("o_custkey").alias("scene"), "o_orderkey", "o_totalprice")
    return joins.same_lists(o, o.where("o_totalprice > 20000"), "scene", "o_orderkey")


@query("j08_shard_semi_join", f"with s as (select scene_id, row_number() over (order by scene_id) - 1 as place from (select distinct scene_id from {sql('metrics_fx')} x) d) select scene_id, frame_id from {sql('metrics_fx')} f where scene_id in (select scene_id from s where place >= 3 and place < 9)")
def j08(spark, sf):
    f = view(spark, sf, "metrics_fx").select("scene_id", "frame_id")
    return joins.shard_range(f, f, "scene_id", 3, 9)


@query("j09_lookup_default", "select l_orderkey, l_linenumber, coalesce(p_brand, 'unannotated') as p_brand from lineitem left join (select p_partkey, p_brand from part where p_size > 25) p on l_partkey = p_partkey")
def j09(spark, sf):
    parts = view(spark, sf, "part").where("p_size > 25").withColumnRenamed("p_partkey", "l_partkey")
    return joins.with_default(view(spark, sf, "lineitem"), parts, "l_partkey", "p_brand", "unannotated").select("l_orderkey", "l_linenumber", "p_brand")


@query("j12_class_colours", "select event_id, case event_type when 'click' then 1 when 'view' then 2 else -1 end as class_id from events")
def j12(spark, sf):
    legend = spark.createDataFrame([("click", 1), ("view", 2)], "event_type string, class_id int")
    return view(spark, sf, "events").join(F.broadcast(legend), "event_type", "left").select("event_id", F.coalesce("class_id", F.lit(-1)).alias("class_id"))


@query("j24_scene_metadata", "select o_orderkey, coalesce(c_acctbal, 0.0) as scale from orders left join customer on o_custkey = c_custkey and c_mktsegment = 'BUILDING'")
def j24(spark, sf):
    meta = view(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return view(spark, sf, "orders").join(meta, "o_custkey", "left").select("o_orderkey", F.coalesce("c_acctbal", F.lit(0.0)).alias("scale"))


@query("j26_plane_metadata", "select s.s_suppkey, l.l_orderkey, l.l_linenumber from supplier s left join lineitem l on s.s_suppkey = l.l_suppkey and l.l_quantity = 1")
def j26(spark, sf):
    rows = view(spark, sf, "lineitem").where("l_quantity = 1").withColumnRenamed("l_suppkey", "s_suppkey")
    return view(spark, sf, "supplier").select("s_suppkey").join(rows, "s_suppkey", "left").select("s_suppkey", "l_orderkey", "l_linenumber")


@query("j27_forward_splat", "select cast(l_partkey % 64 as bigint) as u, cast(l_suppkey % 48 as bigint) as v, arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) as label from lineitem group by 1, 2")
def j27(spark, sf):
    rows = view(spark, sf, "lineitem").select((F.col("l_partkey") % 64).alias("u"), (F.col("l_suppkey") % 48).alias("v"), F.col("l_linenumber").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return joins.splat(rows, ["u", "v"], "label", "seq")


@query("w09_z_buffer", "with o as (select unnest([-1, 0, 1]) as d), p as (select cast(l_partkey % 64 as bigint) + a.d as u, cast(l_suppkey % 48 as bigint) + b.d as v, l_extendedprice as z, l_orderkey as color from lineitem, o a, o b) select v, u, arg_min(color, row(z, color)) as color, round(min(z), 4) as z from p group by v, u")
def w09(spark, sf):
    rows = view(spark, sf, "lineitem").select((F.col("l_partkey") % 64).alias("u"), (F.col("l_suppkey") % 48).alias("v"), F.col("l_extendedprice").alias("z"), F.col("l_orderkey").alias("color"))
    return rounded(joins.z_buffer(rows, [], "color", "z", 1), digits=4)


@query("p24_frame_stride", f"with f as (select scene_id, frame_id, row_number() over (partition by scene_id order by frame_id) - 1 as pos from {sql('metrics_fx')} x) select scene_id, frame_id, pos::int as pos from f where pos % 5 = 0")
def p24(spark, sf):
    return sampling.stride(view(spark, sf, "metrics_fx").select("scene_id", "frame_id"), ["scene_id"], "frame_id", 5)


@query("p25_existing_columns", "select n_nationkey, n_name from nation")
def p25(spark, sf):
    df = view(spark, sf, "nation")
    return df.select(*[c for c in ("n_nationkey", "n_name", "n_population") if c in df.columns])


@query("t04_descending_order", "select p_partkey, row_number() over (order by p_retailprice desc, p_partkey)::int as place from part")
def t04(spark, sf):
    return sampling.position(view(spark, sf, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"]).select("p_partkey", (F.col("pos") + 1).alias("place"))


@query("t05_natural_sort", "select p_name, row_number() over (order by regexp_extract(p_name, '^(.*?)([0-9]*)$', 1), try_cast(regexp_extract(p_name, '([0-9]+)$', 1) as bigint) nulls first, p_partkey)::int as place, p_partkey from part")
def t05(spark, sf):
    rows = view(spark, sf, "part").select("p_name", "p_partkey")
    return sampling.position(rows, [*names.natural("p_name"), "p_partkey"]).select("p_name", (F.col("pos") + 1).alias("place"), "p_partkey")


@query("t06_limited_scenes", "select n_nationkey, n_name from nation order by n_name limit 10")
def t06(spark, sf):
    return view(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_name").limit(10)


@query("t07_contiguous_shards", "select n_nationkey, (ntile(7) over (order by n_nationkey) - 1)::int as shard from nation")
def t07(spark, sf):
    return sampling.shards(view(spark, sf, "nation").select("n_nationkey"), "n_nationkey", 7)


@query("t08_ceil_batches", "select n_nationkey, cast(floor((row_number() over (order by n_nationkey) - 1) / 4.0) as bigint) as batch from nation")
def t08(spark, sf):
    return sampling.batches(view(spark, sf, "nation").select("n_nationkey"), "n_nationkey", 7, 25).select("n_nationkey", "batch")


@query("t09_uniform_subsample", "with p as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos, count(*) over (partition by c_nationkey) as n from customer) select c_nationkey, c_custkey, pos::int as pos from p where n <= 5 or pos in (0, cast(floor(1 * (n - 1) / 4.0) as bigint), cast(floor(2 * (n - 1) / 4.0) as bigint), cast(floor(3 * (n - 1) / 4.0) as bigint), n - 1)")
def t09(spark, sf):
    return sampling.linspace(view(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_custkey", 5, ["c_nationkey"])


@query("t10_seeded_split", f"with r as (select c_custkey, row_number() over (order by {HASH.format(seed=42, key='c_custkey')}, c_custkey) - 1 as pos, count(*) over () as n from customer) select c_custkey, case when pos < cast(floor(n * 0.7 + 1e-9) as bigint) then 'train' when pos < cast(floor(n * 0.85 + 1e-9) as bigint) then 'val' else 'test' end as split from r")
def t10(spark, sf):
    c = view(spark, sf, "customer").select("c_custkey")
    return sampling.split(c, "c_custkey", c.count(), {"train": 0.7, "val": 0.15, "test": 0.15})


@query("t11_random_cap", f"with r as (select l_suppkey, l_orderkey * 10 + l_linenumber as idx, row_number() over (partition by l_suppkey order by {HASH.format(seed=0, key='(l_orderkey * 10 + l_linenumber)')}, l_orderkey * 10 + l_linenumber) as rn from lineitem) select l_suppkey, idx from r where rn <= 20")
def t11(spark, sf):
    rows = view(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"))
    return sampling.capped(rows, ["l_suppkey"], "idx", 20)


@query("t11_stride_sample", "with r as (select l_suppkey, l_orderkey * 10 + l_linenumber as idx, row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber) - 1 as pos, greatest(1, cast(floor(count(*) over (partition by l_suppkey) / 50.0) as bigint)) as k from lineitem) select l_suppkey, idx, pos::int as pos from r where pos % k = 0")
def t11b(spark, sf):
    rows = view(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"))
    return sampling.every_kth(rows, ["l_suppkey"], "idx", 50)


@query("t12_interleave", f"with c as (select c_custkey as id, cast('0x' || substr({HASH.format(seed=0, key='c_custkey')}, 1, 8) as bigint) / 4294967296.0 as coin from customer), o as (select o_orderkey as id, cast('0x' || substr({HASH.format(seed=0, key='o_orderkey')}, 1, 8) as bigint) / 4294967296.0 as coin from orders) select id, 0 as origin from c where coin < 0.3 union all select id, 1 from o where coin >= 0.3")
def t12(spark, sf):
    a, b = view(spark, sf, "customer").select(F.col("c_custkey").alias("id")), view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return sampling.interleaved(a, b, "id", 0.3)


@query("f13_name_collapse", f"select id, regexp_replace(regexp_replace(raw_name, '_obj_[0-9]+$', ''), '_[0-9]+$', '') as name from {sql('names_fx')} n")
def f13(spark, sf):
    return view(spark, sf, "names_fx").select("id", names.collapsed("raw_name").alias("name"))


@query("f14_path_parsing", "select event_id, list_filter(string_split(event_type || '/seq-' || cast(user_id as varchar) || '/frame-' || cast(event_id as varchar), '/'), lambda x: x in ('click', 'view'))[1] as scene, string_split(event_type || '/seq-' || cast(user_id as varchar) || '/frame-' || cast(event_id as varchar), '/')[-1] as frame from events")
def f14(spark, sf):
    e = view(spark, sf, "events").withColumn("path", F.concat_ws("/", "event_type", F.concat(F.lit("seq-"), F.col("user_id").cast("string")), F.concat(F.lit("frame-"), F.col("event_id").cast("string"))))
    return e.select("event_id", names.scene_of("path", ["click", "view"]).alias("scene"), names.last_part("path").alias("frame"))


@query("s24_group_name_gaps", "select g.i as group_id, coalesce(n_name, 'unknown_' || cast(g.i as varchar)) as name from (select unnest(generate_series(0, 30)) as i) g left join (select * from nation where n_nationkey % 3 <> 0) n on n_nationkey = g.i")
def s24(spark, sf):
    known = view(spark, sf, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("group_id"), "n_name")
    return spark.range(31).select(F.col("id").alias("group_id")).join(known, "group_id", "left").select("group_id", F.coalesce("n_name", F.concat(F.lit("unknown_"), F.col("group_id").cast("string"))).alias("name"))


@query("s32_normals_log", "select p_brand || ' ' || printf('%.3f', p_retailprice) || ' ' || cast(p_partkey as varchar) as line, row_number() over (order by p_brand, p_retailprice desc, p_partkey)::int as place from part")
def s32(spark, sf):
    rows = view(spark, sf, "part")
    ordered = sampling.position(rows, ["p_brand", F.desc("p_retailprice"), "p_partkey"])
    return ordered.select(F.format_string("%s %.3f %s", "p_brand", "p_retailprice", F.col("p_partkey").cast("string")).alias("line"), (F.col("pos") + 1).alias("place"))


@query("d01_method_registry", "select m.method, count(*) as n from (select 'a' as method, 0 as label_offset, 20 as nonplanar union all select 'b', 1, 0) m, lineitem where (l_partkey % 21 + m.label_offset) <> m.nonplanar group by 1")
def d01(spark, sf):
    methods = spark.createDataFrame([("a", 0, 20), ("b", 1, 0)], "method string, label_offset int, nonplanar int")
    counts = view(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 21).alias("label")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(methods)).where("label + label_offset <> nonplanar").groupBy("method").agg(F.sum("n").alias("n"))
