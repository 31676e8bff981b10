"""All queries of the library outside the training-data operators, with their SQL."""

from __future__ import annotations

from .plans import aggregates, audits, completion, copies, decisions, exports, extraction, graph, joins, judge, layout, matching, owners, packs, ranking, resolution, retrieval, reviews, scans, steps, text, texts, updates, wiring  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
