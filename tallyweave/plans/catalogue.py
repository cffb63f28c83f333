"""All queries of the core library."""

from __future__ import annotations

from . import composed, general, grouped, joined, kept, scalars

_BOOKS = (scalars.book, joined.book, grouped.book, kept.book, composed.book)
QUERIES = dict(general.QUERIES) | {k: v for b in _BOOKS for k, v in b.queries.items()}
ORACLE = dict(general.ORACLE) | {k: v for b in _BOOKS for k, v in b.oracle.items()}
