"""Operators for large training corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """Registered queries, the corpus pipeline among them, and their SQL."""
    import corpus_pipeline
    from tallyweave.llm.queries import ORACLE, QUERIES

    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return QUERIES | {"pipeline": corpus_pipeline.run}, ORACLE | sql
