"""The pipeline of training-data operators; it belongs to `quillstone.llm`, where its stages are."""

from quillstone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
