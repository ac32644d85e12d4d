"""Registry of named queries: a Spark plan and, where SQL can say it, its oracle text."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .views import Tables, oracle

Plan = Callable[[Tables], DataFrame]
_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is defined twice")
        _PLANS[name] = fn
        if sql:
            _SQL[name] = oracle(sql)
        return fn
    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, with -0.0 as 0.0, for value comparison."""
    return df.select(*[
        (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields])


def load() -> None:
    from .. import plans
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{plans.__name__}.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    bind = lambda fn: lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return {name: bind(fn) for name, fn in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
