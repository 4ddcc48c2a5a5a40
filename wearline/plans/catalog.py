"""Registered queries: name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None).

Each query reads the driver's tables (mostly ``events`` through
``event_readings``) and exercises one family of operators on the whole table.
The oracle is the same computation written as plain DuckDB SQL over the
pre-registered views; doubles are rounded identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from . import q_prepare, q_reports, q_asof, q_misc, q_ml, q_stream  # noqa: F401
