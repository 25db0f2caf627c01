"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from lorespark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
