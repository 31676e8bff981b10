"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .chunks import op7_substring_dedup
from . import filter_audit, licenses, mixing, ranked_search
from .filter_audit import op12_filter_audit
from .langid import op6_language_id
from .licenses import op4_license_scan
from .minhash import op3_minhash_near_dedup
from .mixing import op5_mixing
from .packed_ids import op11_packed_ids
from .pieces import op9_sentencepiece
from .projections import op10_collision_projections
from .ranked_search import op13_ranked_search
from .spotsigs import op8_spot_signatures
from .suffixes import op2_suffix_dedup
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable] = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_minhash_near_dedup, op4_license_scan, op5_mixing, op6_language_id, op7_substring_dedup, op8_spot_signatures, op9_sentencepiece, op10_collision_projections, op11_packed_ids, op12_filter_audit, op13_ranked_search)}
ORACLES: dict[str, str] = {"op4_license_scan": licenses.sql(), "op5_mixing": mixing.sql(), "op12_filter_audit": filter_audit.sql(), "op13_ranked_search": ranked_search.sql()}
