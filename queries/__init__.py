"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

from queries.registry import ORACLES, QUERIES


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module != "registry":
            importlib.import_module(f"{__name__}.{module}")


def all_queries():
    _load()
    return dict(sorted(QUERIES.items()))


def all_oracles():
    _load()
    return dict(sorted(ORACLES.items()))
