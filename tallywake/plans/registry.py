"""All registered queries: name -> (Spark job, SQL for the same result)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["grading", "usage", "streams", "graph", "sessions", "impact", "context", "changes", "evaluation", "corpus"]

Job = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Job, str | None]]:
    found: dict[str, tuple[Job, str | None]] = {}
    for name in MODULES:
        module = importlib.import_module(f"tallywake.plans.{name}")
        for key, pair in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = pair
    return found


def queries() -> dict[str, Job]:
    return {name: job for name, (job, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
