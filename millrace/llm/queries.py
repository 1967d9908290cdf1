"""The queries of this package, by name."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in ("q_cooccur", "q_leaks", "q_neighbours", "q_canonical", "q_packing", "q_clusters", "q_languages", "q_history", "q_pii"):
    _module = import_module(f"millrace.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
