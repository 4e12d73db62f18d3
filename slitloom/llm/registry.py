"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, bitpack, captures, chaining, decontaminate, fertility, resample, sharding, simhash, suffixes

_MODULES = (resample, suffixes, captures, bitpack, bestfit, fertility, decontaminate, simhash, sharding, chaining)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES_BY_NAME.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
