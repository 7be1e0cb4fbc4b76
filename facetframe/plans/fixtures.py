"""Deterministic planar-geometry tables derived from the test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of ``supplier`` that a task makes rasters of: the table is a few MB, one split of a file, whatever its frames come to.
FRAMES = 250

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _numbers(n: int) -> str:
    return "(select " + " union all select ".join(f"{i} as i" for i in range(n)) + ")"


VIEWS = {
    "px_seg": """select cast(l_suppkey % 7 as bigint) as scene_id, cast(l_suppkey as bigint) as frame_id,
        case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as gt, cast(floor(l_quantity / 10) as int) as pred from lineitem""",
    "px_grid": f"""select cast(s_nationkey as bigint) as scene_id, cast(s_suppkey as bigint) as frame_id, a.i as v, b.i as u,
        case when b.i < 16 then 2.0e0 + 0.01e0 * b.i + 0.005e0 * cast(s_suppkey % 3 as int) * a.i else 3.0e0 - 0.01e0 * b.i + 0.02e0 * a.i end as z,
        case when b.i < 16 then 0.0e0 else 0.6e0 end as nx, 0.0e0 as ny, case when b.i < 16 then 1.0e0 else 0.8e0 end as nz,
        case when b.i in (15, 16) then 0.1e0 else 0.9e0 end as planarity, case when b.i < 15 then 1 when b.i > 16 then 2 else 0 end as label
        from supplier cross join {_numbers(24)} a cross join {_numbers(32)} b""",
    "px_marks": f"""select cast(s_nationkey as bigint) as scene_id, cast(s_suppkey as bigint) as frame_id, a.i as v, b.i as u,
        cast(case when (3 * b.i * b.i + 5 * a.i * a.i + 7 * b.i * a.i + s_suppkey) % 13 < 5 then 0 when (3 * b.i * b.i + 5 * a.i * a.i + 7 * b.i * a.i + s_suppkey) % 13 < 9 then 1 else 2 end as int) as label,
        1.0e0 + 0.01e0 * b.i + 0.03e0 * a.i as z from supplier cross join {_numbers(12)} a cross join {_numbers(18)} b where s_suppkey <= 24""",
    "planes_fx": """select plane_id, label, area, a / sqrt(a*a + b*b + c*c) as nx, b / sqrt(a*a + b*b + c*c) as ny, c / sqrt(a*a + b*b + c*c) as nz, d0 as d
        from (select cast(p_partkey as bigint) as plane_id, p_brand as label, cast(p_size as double) as area, (p_size - 25) / 25.0e0 as a,
        ((p_partkey % 11) - 5) / 5.0e0 as b, 1.0e0 as c, p_retailprice / 1000.0e0 as d0 from part) r""",
    "mesh_faces": f"""select cast(n_nationkey as bigint) as scene_id, cast(2 * (a.i * 5 + b.i) + t.i as bigint) as fid,
        cast(case when t.i = 0 then a.i * 6 + b.i else a.i * 6 + b.i + 1 end as bigint) as v0,
        cast(case when t.i = 0 then a.i * 6 + b.i + 1 else (a.i + 1) * 6 + b.i + 1 end as bigint) as v1,
        cast((a.i + 1) * 6 + b.i as bigint) as v2, case when b.i < 3 then 0 else 1 end as label_int,
        cast(case when b.i < 2 then 1 when b.i < 4 then 2 else -1 end as int) as plane_id
        from nation cross join {_numbers(5)} a cross join {_numbers(5)} b cross join {_numbers(2)} t""",
    "mesh_vertices": f"""select cast(n_nationkey as bigint) as scene_id, cast(a.i * 6 + b.i as bigint) as vid, 1.0e0 * b.i as x, 1.0e0 * a.i as y,
        case when b.i <= 3 then 0.1e0 * (n_nationkey % 4) * b.i else 0.1e0 * (n_nationkey % 4) * 3 + 0.5e0 * (b.i - 3) end as z, cast((a.i * 7 + b.i * 3) % 3 as int) as label_int
        from nation cross join {_numbers(6)} a cross join {_numbers(6)} b""",
    "metrics_fx": """select cast(c_nationkey as bigint) as scene_id, cast(o_custkey as bigint) as frame_id, count(*) as n,
        avg(o_totalprice) as m1, max(o_totalprice) - min(o_totalprice) as m2 from orders join customer on o_custkey = c_custkey group by c_nationkey, o_custkey""",
    "keys_fx": """select cast(s_suppkey as bigint) as frame_ord, lpad(cast(s_suppkey as varchar(20)), 5, '0') as gt_key,
        case when s_suppkey % 4 = 0 then cast(s_suppkey as varchar(20)) when s_suppkey % 4 = 1 then lpad(cast(s_suppkey as varchar(20)), 5, '0')
        when s_suppkey % 4 = 2 then concat('frame_', lpad(cast(s_suppkey as varchar(20)), 5, '0')) end as pred_key from supplier""",
    "names_fx": "select cast(p_partkey as bigint) as id, concat(lower(p_brand), '_tile_obj_', cast(p_partkey as varchar(20))) as raw_name from part",
    "outlines": """select cast(l_suppkey % 7 as bigint) as scene_id, cast(l_orderkey as bigint) as fid, cast(l_linenumber as int) as seq, cast(l_quantity as double) as area, cast(l_partkey % 23 as int) as plane_id from lineitem""",
}

#: Three coordinates of each embedding with its label; array positions start at 0 here and at 1 in DuckDB.
POINTS = "select cast(vec_id as bigint) as idx, cast(label as int) as label, cast(embedding[{0}] as double) as x, cast(embedding[{1}] as double) as y, cast(embedding[{2}] as double) as z from embeddings"


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as the rasters made of them need, by ranges of their key: Spark then knows that no frame is in two tasks."""
    tasks = -(-rows.count() // FRAMES)
    return rows.repartitionByRange(tasks, "s_suppkey") if tasks > 1 else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a derived one as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = POINTS.format(0, 1, 2) if name == "points" else VIEWS[name]
    for t in TABLES:
        if t in text:
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (_dealt(rows) if (name, t) == ("px_grid", "supplier") else rows).createOrReplaceTempView(t)
    return spark.sql(text)


def sql(name: str) -> str:
    """The same table as a DuckDB subquery."""
    return "(" + (POINTS.format(1, 2, 3) if name == "points" else VIEWS[name]) + ")"
