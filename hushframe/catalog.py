"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import queries_files, queries_io, queries_outbound, queries_state  # noqa: F401  they register themselves
from .queries import ORACLES, QUERIES, sanitize_documents

__all__ = ["ORACLES", "QUERIES", "sanitize_documents"]
