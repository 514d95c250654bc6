"""End-to-end flows and the registered queries."""

from importlib import import_module

MODULES = ["filters", "privacy", "preparation", "ranking", "contexts", "memory", "graph", "measures", "catalogs", "live"]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"loglattice.plans.{name}")
