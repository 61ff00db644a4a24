"""The stages from raw documents to packed training sequences; they stand in barweave/llm/stages.py."""

from barweave.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
