"""Registered queries: name → (Spark plan builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
application tables of that directory. The oracle is an independent SQL
formulation over the same fixture views (inlined as CTEs), written from
the operator's meaning.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Fixtures, with_views

# Fixed parameters of every registered query (FIXTURES.md).
AS_OF = "2024-01-15"
START, END = "2024-01-08", "2024-01-22"


@dataclass
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: register ``fn(fx) -> DataFrame`` with its oracle SQL."""
    def deco(fn):
        REGISTRY[name] = Query(name, fn, with_views(oracle, *views) if oracle else None)
        return fn
    return deco


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    out = {}
    for n, q in REGISTRY.items():
        out[n] = (lambda b: (lambda spark, sf_dir: b(Fixtures(spark, sf_dir))))(q.build)
    return out


def oracles() -> dict[str, str]:
    _load()
    return {n: q.oracle for n, q in REGISTRY.items() if q.oracle}


_MODULES = ("q_daily", "q_reports", "q_streaks", "q_goals", "q_ingest", "q_teams", "q_maintenance", "q_streaming", "q_ids")


def _load():
    """Import the query modules; each registers its queries on import."""
    for mod in _MODULES:
        importlib.import_module(f"{__package__}.{mod}")
