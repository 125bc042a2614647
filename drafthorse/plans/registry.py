"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register f(views) -> DataFrame. sql may use the named views besides the base tables."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql, uses)
        return f

    return add


GAP = "greatest({a}.y0 - {b}.y1, {b}.y0 - {a}.y1, {a}.x0 - {b}.x1, {b}.x0 - {a}.x1)"
AREA = "({a}.y1 - {a}.y0) * ({a}.x1 - {a}.x0)"
MEET = "greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) * greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
VALID = "({a}.y0 >= 0 and {a}.x0 >= 0 and {a}.y1 <= 1000 and {a}.x1 <= 1000 and {a}.y0 < {a}.y1 and {a}.x0 < {a}.x1)"
UPPER = "upper(replace({c}, 'ß', 'ss'))"
NORM = "upper(replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), 'ß', 'ss'))"


def holds(outer: str, inner: str, tol: float) -> str:
    """SQL: the centre of inner lies in outer."""
    cy, cx = f"({inner}.y0 + {inner}.y1) / 2", f"({inner}.x0 + {inner}.x1) / 2"
    return f"({cy} >= {outer}.y0 - {tol} and {cy} <= {outer}.y1 + {tol} and {cx} >= {outer}.x0 - {tol} and {cx} <= {outer}.x1 + {tol})"
