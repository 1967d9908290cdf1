"""Every query outside millrace.llm, with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "core_shell"
MODULES = ("packed", "q_audit", "q_profiles", "q_groups", "q_runs", "q_text", "q_pipeline", "q_more", "q_review")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"millrace.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
