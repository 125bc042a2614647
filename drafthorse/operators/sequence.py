"""Islands, runs, ranges, covered length and peaks over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs inside `by` from 0: a row for which `breaks` holds begins a new one. breaks may use F.lag over the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__b", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__b")


def ranges(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, start, stop): distinct whole numbers as half-open ranges."""
    w = Window.partitionBy(*by).orderBy(value)
    x = df.select(*by, value).distinct().withColumn("__k", F.col(value) - F.row_number().over(w))
    return x.groupBy(*by, "__k").agg(F.min(value).alias("start"), (F.max(value) + 1).alias("stop")).drop("__k")


def covered_length(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """(by, covered): length of the union of the intervals."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.select(*by, lo, hi).filter(F.col(hi) > F.col(lo)).withColumn("__before", before)
    own = F.greatest(F.lit(0), F.col(hi) - F.greatest(F.col(lo), F.coalesce("__before", F.col(lo))))
    return x.groupBy(*by).agg(F.sum(own).alias("covered"))


def peak_concurrency(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, peak): the most intervals open at once; one that ends when another begins is closed first."""
    steps = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("s")).select(*by, "s.*")
    # one row a moment first: a window then holds moments, not calls
    steps = steps.groupBy(*by, "t", "d").agg(F.sum("d").alias("n"))
    w = Window.partitionBy(*by).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("n").over(w)).groupBy(*by).agg(F.max("open").alias("peak"))
