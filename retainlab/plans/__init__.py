"""Registered query plans.  ``all_queries`` loads every query module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_scoring", "q_data", "q_prep", "q_metrics", "q_models", "q_explain", "q_explain_models", "q_stream")


def all_queries():
    """Return (queries, oracle_sql) after importing every query module."""
    from retainlab.plans.registry import ORACLE, QUERIES

    for mod in MODULES:
        import_module(f"retainlab.plans.{mod}")
    return dict(QUERIES), dict(ORACLE)
