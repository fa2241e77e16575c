"""Imports every plan module so that all queries are registered."""

from __future__ import annotations

from epochwise.plans import registry
from epochwise.plans import q_evaluate, q_events, q_models, q_prepare, q_profile, q_signal, q_stream, q_text  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
