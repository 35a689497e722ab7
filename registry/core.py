"""Registration of queries and assembly of their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, tuple[str, tuple[str, ...]]] = {}
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def sql_view(name: str, body: str, uses: tuple[str, ...] = ()) -> None:
    SQL_VIEWS[name] = (uses, body)


def _ordered(names: tuple[str, ...], seen: dict[str, None]) -> dict[str, None]:
    for n in names:
        if n not in seen:
            _ordered(SQL_VIEWS[n][0], seen)
            seen[n] = None
    return seen


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    ctes = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in _ordered(uses, {})]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + sql


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional SQL check."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = (sql, uses)
        return fn

    return register


def oracle() -> dict[str, str]:
    return {name: with_views(sql, uses) for name, (sql, uses) in CHECKS.items()}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r6(expr: str) -> str:
    """SQL: round to six places; adding zero turns -0 into 0."""
    return f"(round({expr}, 6) + 0e0)"
