"""All queries of the core, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import slatewing.plans as plans


def _modules():
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name != "registry")
    return [importlib.import_module(f"slatewing.plans.{n}") for n in names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        out |= getattr(m, "QUERIES", {})
    return out


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= getattr(m, "SQL", {})
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["p2_found"](spark, sf_dir)
