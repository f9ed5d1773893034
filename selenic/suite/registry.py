"""Named queries over the benchmark tables, each with its oracle text."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selenic.fixtures import Inputs, duck


@dataclass
class Query:
    build: Callable[[Inputs], DataFrame]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Inputs(spark, sf_dir))


QUERIES: dict[str, Query] = {}
MODULES = ("scalars", "relations", "cells", "matching", "logs", "files", "jobs")


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = Query(build, duck(oracle) if oracle else None)
        return build
    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for the value comparison, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def load_suite() -> None:
    for m in MODULES:
        importlib.import_module(f"selenic.suite.{m}")
