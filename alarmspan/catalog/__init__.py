"""Queries over the driver's tables."""
from __future__ import annotations

import importlib

MODULES = ("lead_time", "preparation", "windows", "assets", "models", "streams", "files")


def load_catalog():
    from alarmspan.catalog.registry import ORACLES, QUERIES
    for name in MODULES:
        importlib.import_module(f"alarmspan.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
