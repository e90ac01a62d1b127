"""Driver-table adapters and the registry of checked queries."""

from importlib import import_module

MODULES = ("intervals", "text", "turns", "stats", "people", "items", "evaluation", "catalog", "plans", "streams")


def load():
    for m in MODULES:
        import_module(f"checks.{m}")
    from checks.registry import QUERIES, oracle_texts

    return dict(QUERIES), oracle_texts()
