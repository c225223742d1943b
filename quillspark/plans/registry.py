"""All registered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that hold QUERIES and ORACLES.
MODULES: list[str] = ["evaluation", "control", "operations", "generated"]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"{__package__}.{name}").ORACLES
    return out
