"""Registered queries and their SQL."""

from __future__ import annotations


def registry() -> list:
    """Modules with QUERIES and SQL."""
    from quotewright.plans import corpus, orphans, shapes, text, verify

    return [orphans, text, corpus, verify, shapes]
