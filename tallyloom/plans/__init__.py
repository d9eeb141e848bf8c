"""Queries over the given tables."""

from importlib import import_module

MODULES = ("scoring", "metrics", "health", "bench", "text", "retrieval", "ordered", "sources", "learned", "streams")


def load_all():
    from tallyloom.plans.registry import ORACLES, QUERIES

    for module in MODULES:
        import_module(f"tallyloom.plans.{module}")
    return QUERIES, ORACLES
