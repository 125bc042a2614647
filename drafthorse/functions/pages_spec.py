"""Page selections such as `1,3-5`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pages_of(spec: Column, total: Column) -> Column:
    """Sorted distinct pages of a selection; empty or `all`: every page. Ranges may be swapped, what is out of range is ignored."""
    s = F.lower(F.trim(F.coalesce(spec, F.lit(""))))
    parts = F.filter(F.split(s, r"[,\s]+"), lambda p: p != "")
    lo = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
    hi = lambda p: F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int")).otherwise(lo(p))

    def span(p: Column) -> Column:
        a, b = F.greatest(F.lit(1), F.least(lo(p), hi(p))), F.least(total, F.greatest(lo(p), hi(p)))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("cast(array() as array<int>)"))

    everything = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.when(s.isin("", "all"), everything).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span)))))
