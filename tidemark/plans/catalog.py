"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("timeline", "scalar", "intervals", "text", "phases", "transcripts", "boxes", "candidates", "io")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _name in _MODULES:
    _module = importlib.import_module(f"tidemark.plans.catalog_{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
