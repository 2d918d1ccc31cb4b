"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations


def registry() -> list:
    """Modules with QUERIES and SQL, in the order of the problems."""
    from quotewright.llm import queries

    return [queries]
