"""Named queries: each pairs a Spark builder over the canonical tables with
its DuckDB oracle SQL (``None`` for model / stateful queries, which are
checked by row count and properties instead)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from basketlens.plans.oracle import with_canon
from basketlens.sources.adapter import Canon


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Canon], DataFrame]
    sql: str | None
    ref: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ref: str, sql: str | None = None, ctes: str = "", raw_sql: bool = False):
    """Register ``fn(canon) -> DataFrame``; ``sql`` is a body over the
    canonical CTEs (or a complete statement when ``raw_sql``)."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = None if sql is None else (sql if raw_sql else with_canon(sql, ctes))
        REGISTRY[name] = Query(name, fn, full, ref)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens on import)."""
    from basketlens.plans import (  # noqa: F401
        q_sources, q_quality, q_kpi, q_behaviour, q_features, q_evaluate, q_basket, q_models, q_selection,
        q_roundtrips, q_ensemble)
    return REGISTRY
