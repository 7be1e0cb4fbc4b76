"""All registered queries over the reference operators and their SQL twins."""

from __future__ import annotations

from . import comparison_queries, dataset_queries, extension_queries, frame_queries, growth_queries, label_queries, mesh_queries, pass_queries, plane_queries, source_queries, table_queries

_MODULES = (label_queries, frame_queries, plane_queries, mesh_queries, table_queries, source_queries, growth_queries, extension_queries, dataset_queries, pass_queries, comparison_queries)

QUERIES = {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
