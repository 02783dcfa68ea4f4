"""Queries by name, each with the operators it covers and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenlit.plans.testbed import Bed, sql


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Bed], DataFrame]
    twin: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, parts: str = "", twin: str | None = None):
    """Register a function of a test bed. ``parts`` names the relations that
    the twin builds on."""

    def add(f: Callable[[Bed], DataFrame]):
        if f.__name__ in REGISTRY:
            raise ValueError(f"two queries named {f.__name__}")
        text = None if twin is None else (sql(parts, twin) if parts else twin)
        REGISTRY[f.__name__] = Query(f.__name__, tuple(covers.split()), f, text)
        return f

    return add


def _load() -> None:
    from lumenlit.plans import claims, documents, engine, more, reading, sets, shapes, streams, vectors  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, q=q: q.run(Bed(spark, sf_dir))) for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: q.twin for n, q in REGISTRY.items() if q.twin is not None}
