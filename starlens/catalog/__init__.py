"""The queries over the given tables, each with its oracle statement where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from starlens.catalog.base import REGISTRY, Query

MODULES = ("text", "ratings", "evaluation", "sampling", "scoring", "profiling", "learning", "streams", "files")


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"starlens.catalog.{name}")
    return REGISTRY
