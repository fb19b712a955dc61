"""Composed jobs and the registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of registered queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
