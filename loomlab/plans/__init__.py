"""Registered queries: every module below binds operators to the given tables."""

from __future__ import annotations

import importlib

MODULES = (
    "features",
    "experiments",
    "catalog",
    "reports",
    "text",
    "media",
    "io",
    "maintenance",
    "streams",
    "learning",
)


def _load():
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.registry")


def all_queries():
    return _load().QUERIES


def all_oracles():
    return _load().ORACLES
