"""Training-corpus pipeline: STAGES applied in order to ``documents``."""

from __future__ import annotations

from quarry.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["STAGES", "ORACLE_SQL", "run"]
