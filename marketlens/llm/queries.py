"""Named queries of this subpackage: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _name in ("q_text", "q_dedup", "q_models", "q_vectors"):
    _m = importlib.import_module(f"marketlens.llm.{_name}")
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
