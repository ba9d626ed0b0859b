"""Registered queries over the tables, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("storage", "sequences", "graphs", "texts", "numeric", "views", "hierarchies", "validation", "records", "narrative", "resolving", "parsing", "annotating", "worlds")


def load() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
