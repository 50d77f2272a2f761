"""Registry of named queries: Spark callable plus (optional) DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from marketlens.session import files_state
from marketlens.sources.tables import TABLES

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, note)
        return fn
    return deco


_KEPT: dict = {}


def kept_result(name: str):
    """Keep one run's result for the queries that present it, like a fitted object's last result.

    It is kept for an application, a data folder and the state of the folder's files: rewritten
    tables give a new run.  ``forget_results`` drops everything, for independent timings.
    """
    def deco(fn):
        def wrapper(spark, sf):
            key = (name, spark.sparkContext.applicationId, str(sf))
            state = files_state(spark, sf, TABLES)
            if key not in _KEPT or _KEPT[key][0] != state:
                _KEPT[key] = (state, fn(spark, sf))
            return _KEPT[key][1]

        def kept(spark, sf):
            """The result of an earlier call, if it holds, else None."""
            found = _KEPT.get((name, spark.sparkContext.applicationId, str(sf)))
            return found[1] if found and found[0] == files_state(spark, sf, TABLES) else None
        wrapper.kept = kept
        wrapper.__name__ = fn.__name__
        wrapper.__doc__ = fn.__doc__
        return wrapper
    return deco


def forget_results() -> None:
    _KEPT.clear()
