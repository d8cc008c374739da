"""Registered queries, grouped like the operators they exercise."""

from importlib import import_module

MODULES = ("scalar", "windowing", "ordering", "joins", "reports", "adapting", "inferring", "floors", "sourcing", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
