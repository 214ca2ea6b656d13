"""The training-data pipeline over ``documents``; its stages are in ``tessera.llm.pipeline``."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
