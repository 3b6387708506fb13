"""Queries over the driver's tables, registered by name together with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("scoring", "records", "chat", "pairs", "sweeps", "vectors", "streams")


def registered() -> tuple[dict[str, Callable], dict[str, str]]:
    for module in MODULES:
        import_module(f"fieldmill.plans.{module}")
    base = import_module("fieldmill.plans.base")
    return base.QUERIES, base.ORACLES
