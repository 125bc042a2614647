"""Incremental behaviour on the events table."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import incremental
from .registry import query


@query("t01_windowed_counts", "select epoch_us(ts)::bigint // 3600000000 * 3600 as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def t01(v):
    return incremental.windowed_counts(v.table("events"))


@query("t02_retry_state", "select user_id as key, count(*) as attempts, cast(600 * power(2, least(count(*), 3)) as bigint) as deadline, count(*) <= 3 as retry from events where event_type = 'error' or value > 97 group by user_id")
def t02(v):
    e = v.table("events").filter("event_type = 'error' or value > 97")
    return incremental.retries(e.select(F.col("user_id").alias("key")))


@query("t03_late_refused", "select event_id, case when event_id % 4 = user_id % 4 then 'accepted' else 'stale' end as fate from events")
def t03(v):
    e = v.table("events")
    now = e.select("event_id", (F.col("user_id") % 4).alias("sig"))
    ok, stale = incremental.refuse_late(e.select("event_id", (F.col("event_id") % 4).alias("sig")), now, ["event_id"])
    return ok.select("event_id", F.lit("accepted").alias("fate")).unionByName(stale.select("event_id", F.lit("stale").alias("fate")))


_LAST = "select user_id, max(event_id) as last_event, count(*) as events from events group by user_id"


def _arrivals(v, at: str):
    """The events, a file for each of four parts of the users, as a folder to be drained."""
    x = v.table("events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("events"))
    x.repartition(4, "user_id").write.parquet(f"{at}/in")
    return x


@query("t04_incremental_upsert", _LAST)
def t04(v):
    """A folder drained as a stream, a file a batch, into a versioned table; the last version is returned."""
    at = scratch(v.spark)
    x = _arrivals(v, at)
    sink = incremental.upsert(f"{at}/out", ["user_id"], ["last_event", "events"])
    incremental.drain(v.spark, f"{at}/in", x.schema, f"{at}/checkpoint", sink, files_a_batch=1)
    return incremental.last_version(v.spark, f"{at}/out").select("user_id", "last_event", "events")


@query("t05_failed_chunk", _LAST)
def t05(v):
    """A drain that fails in its second batch, after the batch was written, and is taken up again: nothing is lost or doubled."""
    at, failed = scratch(v.spark), []
    x = _arrivals(v, at)
    write = incremental.upsert(f"{at}/out", ["user_id"], ["last_event", "events"])

    def sink(batch, number):
        write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("worker lost")

    for _ in range(2):
        try:
            incremental.drain(v.spark, f"{at}/in", x.schema, f"{at}/checkpoint", sink, files_a_batch=1)
        except StreamingQueryException:
            continue
    return incremental.last_version(v.spark, f"{at}/out").select("user_id", "last_event", "events")
