"""Named queries over the given tables."""

from __future__ import annotations

import importlib
import importlib.util

FAMILIES = ("corpus", "similarity", "quality", "books", "fleet", "live", "stored")


def _load():
    from lodestrata.plans import catalog

    for family in FAMILIES:
        if importlib.util.find_spec(f"lodestrata.plans.{family}"):
            importlib.import_module(f"lodestrata.plans.{family}")
    return catalog


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict:
    return dict(_load().ORACLE)
