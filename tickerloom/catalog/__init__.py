"""All named queries."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from tickerloom.catalog import registry
from tickerloom.session import ship_package

MODULES = ["bars", "news", "evaluation", "series", "learning"]


def prepared(fn):
    """Dates are UTC days, and Python workers need this package."""
    @wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def load():
    for name in MODULES:
        import_module(f"tickerloom.catalog.{name}")
    return {k: prepared(fn) for k, fn in registry.QUERIES.items()}, registry.CHECKS
