"""Derived tables, named queries and their checks."""

from importlib import import_module

MODULES = (
    "metric_queries", "corpus_queries", "trace_queries", "structure_queries", "report_queries",
)


def _load() -> None:
    for m in MODULES:
        import_module(f"corpuslab.plans.{m}")


def all_queries() -> dict:
    _load()
    from corpuslab.plans.registry import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    from corpuslab.plans.registry import ORACLES

    return dict(ORACLES)
