"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib

MODULES = (
    "scoring_queries",
    "statistics_queries",
    "cost_queries",
    "answer_queries",
    "shaping_queries",
    "ingest_queries",
)


def _load():
    for name in MODULES:
        importlib.import_module(f"marginalia.plans.{name}")
    from marginalia.plans import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
