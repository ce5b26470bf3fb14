"""All queries of the operators, by name, and their SQL."""

from __future__ import annotations


def _load():
    from . import aggregates_and_decisions, calendar_and_joins, decision_tables, model_queries, registry, templates_and_intervals, wide_tables_and_services, windows_and_texts

    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict:
    return dict(_load().ORACLE)
