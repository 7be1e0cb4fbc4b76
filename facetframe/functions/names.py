"""Names, paths and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(name: str) -> Column:
    """Instance name to class name: an ``_obj_<n>`` or trailing ``_<n>`` goes, digits inside the name stay."""
    return F.regexp_replace(F.regexp_replace(F.col(name), r"_obj_[0-9]+$", ""), r"_[0-9]+$", "")


def natural(name: str) -> list[Column]:
    """Sort keys of names that end in a number: the part before it, then the number."""
    return [F.regexp_extract(name, r"^(.*?)([0-9]*)$", 1), F.regexp_extract(name, r"([0-9]+)$", 1).try_cast("bigint")]


def scene_of(path: str, known: list[str]) -> Column:
    """The first folder of a path that is a known scene."""
    return F.get(F.filter(F.split(path, "[/\\\\]"), lambda x: x.isin(known)), F.lit(0))


def last_part(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def padded(number: str, width: int = 5) -> Column:
    return F.lpad(F.col(number).cast("string"), width, "0")
