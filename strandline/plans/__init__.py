"""Named queries of the core, each a function of (spark, directory)."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["panel_problems", "place_problems", "series_queries", "join_queries", "aggregate_queries", "text_queries", "model_queries", "record_queries", "movement_queries", "source_queries", "backtest_queries", "pipeline_queries", "summary_queries"]


def core_queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"strandline.plans.{m}").QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"strandline.plans.{m}").SQL.items()}
