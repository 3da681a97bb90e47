"""Queries over the test tables, each with its ANSI SQL counterpart."""

from importlib import import_module

FAMILIES = ("cleaning", "aggregating", "encoding", "histories", "sequencing", "scalars", "evaluating", "profiles", "storing", "learning")


def load() -> None:
    """Import every family once; importing registers its queries."""
    for family in FAMILIES:
        import_module(f"cartloom.plans.{family}")
