"""Incremental work: a folder of pages read as a stream, results upserted, late results refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.state import merge_rows


def drain(spark: SparkSession, source: str, schema: StructType, checkpoint: str, sink: Callable[[DataFrame, int], None], files_a_batch: int = 100) -> None:
    """Work through what is new in a Parquet folder and stop; the checkpoint remembers what was done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def upsert(target: str, keys: list[str], columns: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that merges each batch into a Parquet table of versions: `target/v=<batch>` is the whole state after a batch.

    A batch that runs twice writes its version again from the one before it, so a retry changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        change = batch.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in columns))
        state = merge_rows(spark.read.parquet(f"{target}/v={number - 1}"), change, keys, columns) if number else change
        state.write.mode("overwrite").parquet(f"{target}/v={number}")

    return run


def last_version(spark: SparkSession, target: str) -> DataFrame:
    """The newest state that upsert() has written."""
    versions = spark.read.parquet(target)
    newest = versions.agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{target}/v={newest}")


def refuse_late(results: DataFrame, current: DataFrame, keys: list[str], sig: str = "sig") -> tuple[DataFrame, DataFrame]:
    """(accepted, stale): results whose signature is still the current one, and the others."""
    now = current.select(*keys, F.col(sig).alias("__now"))
    x = results.join(now, keys, "left").withColumn("__ok", F.coalesce(F.col(sig) == F.col("__now"), F.lit(False)))
    return x.filter("__ok").drop("__ok", "__now"), x.filter("not __ok").drop("__ok", "__now")


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window of event time; as a stream, rows later than `late` are left out."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    x = e.groupBy(F.window("at", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select((F.unix_micros("window.start") / 1000000).cast("long").alias("start"), "event_type", "n", "total")


def retries(failures: DataFrame, base: int = 600, limit: int = 3) -> DataFrame:
    """(key, attempts, deadline, retry): each failure doubles the deadline; after `limit` a key rests."""
    x = failures.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"))
    return x.select("key", "attempts", (F.lit(base) * F.pow(F.lit(2.0), F.least("attempts", F.lit(limit)))).cast("long").alias("deadline"), (F.col("attempts") <= limit).alias("retry"))
