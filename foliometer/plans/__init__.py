"""Queries over the driver's test tables, each with its SQL counterpart."""

from __future__ import annotations


def load_queries():
    """All registered queries by name."""
    from . import dashboards, documents, scalars, streams, tables  # noqa: F401
    from .registry import QUERIES

    return QUERIES
