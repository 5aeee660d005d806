"""Registered queries: every operator on the given tables, with its SQL where one exists."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("sources", "panels", "graphs", "inference", "gates", "entities", "studies")


def load() -> tuple[dict, dict]:
    for family in FAMILIES:
        import_module(f"tallyweave.catalog.{family}")
    from tallyweave.catalog.registry import ORACLE, QUERIES

    return dict(QUERIES), dict(ORACLE)
