"""Imports every query module, so that all queries are registered."""

from __future__ import annotations

from epochwise.llm import q_files, q_groups, q_records, q_text, q_words, registry  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
