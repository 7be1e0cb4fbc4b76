"""The scalar operators as SQL functions: bodies are SQL, so Catalyst inlines them like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geometry import Pinhole

FUNCTIONS = {
    "label_shift(l BIGINT) RETURNS BIGINT": "CASE WHEN l < 0 THEN 0 ELSE l + 1 END",
    "plane_distance(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE": "abs(a * x + b * y + c * z + d)",
    "normal_angle(ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by DOUBLE, bz DOUBLE) RETURNS DOUBLE": "degrees(acos(greatest(-1D, least(1D, ax * bx + ay * by + az * bz))))",
    "rgb_metres(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE": "5000D * (r + 256D * g + 65536D * b) / 16777215D",
    "area_tier(a DOUBLE, small DOUBLE, normal DOUBLE, big DOUBLE) RETURNS STRING": "CASE WHEN a < small THEN 'small' WHEN a < normal THEN 'normal' WHEN a < big THEN 'big' ELSE 'huge' END",
    "valid_depth(z DOUBLE) RETURNS BOOLEAN": "coalesce(NOT isnan(z) AND z > 0 AND z < double('infinity'), false)",
}


def register(spark: SparkSession, camera: Pinhole | None = None) -> list[str]:
    """Creates the functions for this session (camera functions if one is given); returns their names."""
    made = dict(FUNCTIONS)
    if camera:
        made["camera_x(u DOUBLE, z DOUBLE) RETURNS DOUBLE"] = f"(u - {camera.cx}D) * z / {camera.fx}D"
        made["camera_y(v DOUBLE, z DOUBLE) RETURNS DOUBLE"] = f"(v - {camera.cy}D) * z / {camera.fy}D"
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in made]
