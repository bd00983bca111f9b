"""Registered queries over the given tables."""

import importlib
import pkgutil

from . import registry


def load_all():
    """(queries, SQL twins), loaded on first use."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(registry.QUERIES), dict(registry.SQL)
