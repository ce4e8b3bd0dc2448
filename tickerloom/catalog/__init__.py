"""Registered queries: each pairs a Spark plan over the given tables with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from .registry import ORACLES, QUERIES

MODULES = ("windows", "temporal", "sinks", "joins", "graphs", "matching", "settlement", "text", "aggregates",
           "selection", "evaluation", "streams")


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(QUERIES), dict(ORACLES)
