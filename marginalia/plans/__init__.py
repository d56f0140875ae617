"""Registered queries, grouped by area."""

from importlib import import_module

AREAS = ("catalog", "lexical", "text", "chunk", "fulltext", "vector", "index")


def load_all() -> None:
    for area in AREAS:
        import_module(f"marginalia.plans.{area}_queries")
