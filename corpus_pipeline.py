"""The pipeline from raw documents to packed sequences; its stages are in quirelight.llm.pipeline."""

from quirelight.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
