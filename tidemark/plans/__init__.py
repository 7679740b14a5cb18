"""Registered queries, grouped as the operator inventory is."""

from importlib import import_module

from .registry import QUERIES, Query, Tables, runner

_MODULES = ("sources", "projections", "joins", "aggregates", "windows", "rankings", "scalars",
            "decomposition", "models", "diagnosis", "retrieval", "micropanel")


def load_all() -> dict[str, Query]:
    for m in _MODULES:
        import_module(f"{__name__}.{m}")
    return QUERIES


__all__ = ["QUERIES", "Query", "Tables", "load_all", "runner"]
