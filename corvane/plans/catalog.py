"""The registered queries of the library and their DuckDB equivalents, one module a subject."""

from __future__ import annotations

from corvane.plans import curation, files, geometry, names, reductions, results, splits

FLAGSHIP = "decision_ranking"
QUERIES: dict = {}
ORACLES: dict = {}
for _part in (results, curation, geometry, splits, names, files, reductions):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
