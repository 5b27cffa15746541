"""Registered queries: one module per survey section, each query with its SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    from queries.base import QUERIES, SQL

    for info in pkgutil.iter_modules(__path__):
        if info.name != "base":
            importlib.import_module(f"queries.{info.name}")
    return QUERIES, SQL
