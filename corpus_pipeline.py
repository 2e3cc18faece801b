"""A corpus pipeline of five stages, each over all rows that its predecessor kept: see quillon/llm/stages.py."""

from quillon.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
