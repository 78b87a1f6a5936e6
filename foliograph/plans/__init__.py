"""Queries over the mapped library, one per operator, with SQL to check them by."""

from __future__ import annotations

import importlib
from typing import NamedTuple

MODULES = ("expressions", "layout", "anchoring", "graph", "answers", "documents", "history")


class Registered(NamedTuple):
    queries: dict
    oracles: dict


def registered() -> Registered:
    for module in MODULES:
        importlib.import_module(f"foliograph.plans.{module}")
    from foliograph.plans import registry

    return Registered(registry.QUERIES, registry.ORACLES)
