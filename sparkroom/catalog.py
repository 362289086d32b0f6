"""Every query of the raster and metadata operators, with its SQL."""

from __future__ import annotations

from sparkroom import queries_colour, queries_files, queries_metadata, queries_pixels, queries_statistics

_MODULES = (queries_pixels, queries_colour, queries_statistics, queries_metadata, queries_files)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
