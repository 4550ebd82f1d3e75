"""Registered queries: each operator on the driver's tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil

from chronoweave.plans.registry import REGISTRY, Registry


def registry() -> Registry:
    """All queries of this subpackage."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY
