"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ("persistence", "search", "detections", "tracking", "diagnostics", "ingest", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
