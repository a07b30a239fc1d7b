"""Registered queries: each has a Spark form and, where SQL can express it, an equivalent SQL text."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = (
    "geometry", "pairs", "evaluation", "suppression", "ingest", "quality", "statistics", "analytics", "masks", "labels",
    "tracking", "logs", "files",
)


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")


__all__ = ["ORACLES", "QUERIES", "load"]
