"""Every query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with QUERIES (name -> query) and ORACLES (name -> SQL).
PLANS: tuple[str, ...] = ("warehouse", "series", "models", "files", "raster")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in PLANS:
        found = getattr(import_module(f"gridloom.plans.{name}"), attribute)
        if both := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        out |= found
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
