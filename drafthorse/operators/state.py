"""Signatures, currency of stored results, work lists, stores with two layers, and differences of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(*parts: Column, size: int = 12) -> Column:
    """First digits of the SHA-1 of the parts, null as the empty text."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.left(F.sha1(text.cast("binary")), F.lit(size))


def group_signature(df: DataFrame, by: list[str], value: Column, size: int = 12) -> DataFrame:
    """(by, sig): signature of the sorted values of a group, whatever the order of rows."""
    return df.groupBy(*by).agg(F.left(F.sha1(F.array_join(F.sort_array(F.collect_list(value.cast("string"))), ",").cast("binary")), F.lit(size)).alias("sig"))


def currency(wanted: DataFrame, stored: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """wanted with state: current (all facts are stored alike), stale, or missing."""
    s = stored.select(*keys, *(F.col(c).alias(f"__{c}") for c in facts), F.lit(True).alias("__there"))
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    state = F.when(F.col("__there").isNull(), "missing").when(same, "current").otherwise("stale")
    return wanted.join(s, keys, "left").withColumn("state", state).drop("__there", *(f"__{c}" for c in facts))


def work_list(upstream: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are current upstream and not current in the own stage."""
    return upstream.filter("state = 'current'").select(keys).join(own.filter("state = 'current'").select(keys), keys, "left_anti")


def prefer_new(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both layers, of a key in both the new one; layer says which."""
    both = new.withColumn("layer", F.lit("new")).unionByName(old.withColumn("layer", F.lit("old")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("layer") == "old"))
    return both.withColumn("__r", rank).filter("__r = 1").drop("__r")


def split_legacy(old: DataFrame, new: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Each old row with what a migration does to it: written (not there yet), skipped (there, equal), kept (there, other)."""
    n = new.select(*keys, F.col(payload).alias("__p"), F.lit(True).alias("__there"))
    act = F.when(F.col("__there").isNull(), "written").when(F.col(payload).eqNullSafe(F.col("__p")), "skipped").otherwise("kept")
    return old.join(n, keys, "left").withColumn("action", act).drop("__p", "__there")


def merge_rows(base: DataFrame, change: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with the changed rows in place of its own and the new ones added; doing it twice changes nothing."""
    c = change.select(*keys, *(F.col(x).alias(f"__{x}") for x in columns), F.lit(True).alias("__there"))
    x = base.join(c, keys, "full")
    return x.select(*keys, *(F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def compare_rows(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, outcome): missing (not in two), extra (not in one), differing or equal, nulls being equal to nulls."""
    a = one.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("a__"))
    b = two.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("b__"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    outcome = F.when(F.col("b__").isNull(), "missing").when(F.col("a__").isNull(), "extra").when(same, "equal").otherwise("differing")
    return a.join(b, keys, "full").select(*keys, outcome.alias("outcome"))


def metric_diff(before: DataFrame, after: DataFrame, keys: list[str], metric: str, higher_is_better: bool = True) -> DataFrame:
    """(keys, before, after, outcome): better, worse, same, or info where one side is missing."""
    x = before.select(*keys, F.col(metric).alias("before")).join(after.select(*keys, F.col(metric).alias("after")), keys, "full")
    up = F.col("after") > F.col("before")
    outcome = F.when(F.col("before").isNull() | F.col("after").isNull(), "info").when(F.col("before") == F.col("after"), "same").when(up if higher_is_better else ~up, "better").otherwise("worse")
    return x.withColumn("outcome", outcome)
