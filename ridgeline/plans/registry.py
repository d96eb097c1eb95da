"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from ridgeline.plans import files, sight, sites

MODULES = (sight, sites, files)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
