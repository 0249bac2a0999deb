"""Every query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from quill.plans import analysis, behaviour, catalogue, documents, queue, reports, runs, triage  # noqa: F401  they register themselves
from quill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
