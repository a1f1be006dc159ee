"""The queries op1 to op10 and their SQL, for the registry of the entry module."""

from __future__ import annotations

from . import queries_match, queries_native, queries_text

QUERIES = {**queries_native.QUERIES, **queries_match.QUERIES, **queries_text.QUERIES}
ORACLES = {**queries_native.ORACLES, **queries_match.ORACLES, **queries_text.ORACLES}
