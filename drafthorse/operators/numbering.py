"""Gapless row numbers inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions


def number_within(df: DataFrame, by: list[str], order: list[str], name: str, chunks: int | None = None) -> DataFrame:
    """Add `name`: 0, 1, 2 ... inside each group of `by` (no nulls there).

    A group is dealt over hash chunks of `order`; rows are numbered inside a chunk, and each chunk starts
    where the chunks before it end. So a group that holds a third of all rows is still numbered by many tasks.
    df is read twice: hand in something cheap or materialized.
    """
    chunks = chunks or shuffle_partitions(df.sparkSession)
    dealt = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
        .select(*by, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order)
    return (
        dealt.withColumn("__row", F.row_number().over(inside) - 1)
        .join(starts, [*by, "__chunk"])
        .withColumn(name, (F.col("__start") + F.col("__row")).cast("long"))
        .drop("__chunk", "__row", "__start")
    )


def number_along(df: DataFrame, by: list[str], along: str, order: list[str], name: str, chunks: int | None = None) -> DataFrame:
    """Add `name`: 0, 1, 2 ... inside each group of `by` in the order of (along, order).

    along: a column of whole numbers, not null. Chunks are its ranges, so the numbers follow it through the whole group.
    df is read twice, and once more for the greatest `along`.
    """
    chunks = chunks or shuffle_partitions(df.sparkSession)
    top = df.agg(F.max(along)).first()[0] or 0
    dealt = df.withColumn("__chunk", F.least(F.floor(F.col(along) / (top + 1) * chunks), F.lit(chunks - 1)).cast("int"))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
        .select(*by, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(*by, "__chunk").orderBy(along, *order)
    return (
        dealt.withColumn("__row", F.row_number().over(inside) - 1)
        .join(starts, [*by, "__chunk"])
        .withColumn(name, (F.col("__start") + F.col("__row")).cast("long"))
        .drop("__chunk", "__row", "__start")
    )
