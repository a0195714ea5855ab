"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.plans.tables import CTES, Tables

FLAGSHIP = "jn10_poi_density_buf200"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(tables) -> DataFrame``; the SQL may name the surrogate tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            named = ", ".join(f"{n} AS ({body})" for n, body in CTES.items())
            ORACLES[name] = f"WITH RECURSIVE {named}, answer AS ({sql.strip()}) SELECT * FROM answer"
        return f

    return add


for _module in ("core", "buffers", "rasters", "graphs", "scoring", "groups"):
    importlib.import_module(f"kerbline.plans.{_module}")
