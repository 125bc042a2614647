"""Joins of boxes on one page by closeness, without a nested loop over pages or whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import Box, gap

CELL = 40.0


def named(df: DataFrame, prefix: str, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    return df.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys))


def box_join(left: DataFrame, right: DataFrame, tol: float = 0.0, test: Column | None = None, keys: tuple[str, ...] = ("page",), cell: float = CELL, how: str = "inner") -> DataFrame:
    """Pairs l_*, r_* on equal keys whose axis gaps are at most tol and that pass `test`; how: inner, left_semi or left_anti.

    A left row is filed under the one band of `cell` height in which it begins, a right row under all bands in which a
    left row of its page that it can meet may begin; how far up these go is the height of the page's tallest left row. So
    a pair is met once, a dense page (whose rows are low) is many keys, and semi and anti joins need no distinct and no
    second join. Left rows without a box meet nothing.
    """
    band = lambda v: F.floor(v / cell).cast("int")
    a, b = named(left, "l", keys), named(right, "r", keys)
    tall = left.groupBy(*keys).agg(F.max(F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))).alias("__tall"))
    a = a.withColumn("__band", band(F.col("l_y0")))
    low, high = band(F.col("r_y0") - tol - F.col("__tall")), band(F.greatest("r_y0", "r_y1") + tol)
    b = b.join(tall, list(keys)).withColumn("__band", F.explode(F.sequence(low, high))).drop("__tall")
    near = gap(Box("l"), Box("r")) <= tol
    near = near & test if test is not None else near
    if how == "inner":
        return a.join(b, [*keys, "__band"]).filter(near).drop("__band")
    on = near & (F.col("a.__band") == F.col("b.__band"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    own = [c for c in left.columns if c not in keys]
    hit = a.alias("a").join(b.alias("b"), on, how)
    return hit.select(*keys, *(F.col(f"l_{c}").alias(c) for c in own)).select(*left.columns)


def argmin_join(pairs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first pair of each left row in this order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
