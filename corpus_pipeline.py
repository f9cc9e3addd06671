"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, pieces.

The stages are defined in :mod:`millrace.llm.stages`.
"""

from __future__ import annotations

from millrace.llm.stages import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
