"""Query catalogue. Importing a module of this package registers its queries."""

from __future__ import annotations

import importlib

from cuemill.plans.registry import QUERIES, Query

MODULES = (
    "foundations",
    "intervals",
    "offsets",
    "evidence",
    "catalogue",
    "selection",
    "texts",
    "parallel",
    "ingest",
    "grouped",
    "streams",
)


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"cuemill.plans.{module}")
    return QUERIES
