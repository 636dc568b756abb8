"""All registered queries of the code-analytics side, with their SQL twins."""

from __future__ import annotations

from . import analysis, hir, linking, scan, symbols, units

MODULES = [scan, symbols, analysis, units, linking, hir]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
