"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark passages, encoding.

The stages are in tessera/llm/pipeline.py."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
