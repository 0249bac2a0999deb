"""The training-data pipeline: five operators in turn over documents."""

from __future__ import annotations

from quill.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
