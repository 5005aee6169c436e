"""Change feed: a stateless stream of restatement events that keeps a latest table fresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bitemporal import LatestCache
from ..schemas import CHANGE_EVENT


def change_events(vintages: DataFrame) -> DataFrame:
    """An event (key, changed_at in milliseconds) for each new vintage."""
    return vintages.select("key", F.unix_millis("recorded_at").alias("changed_at"))


def publish(events: DataFrame, path: str) -> None:
    """Append events to the feed's folder; a Kafka topic takes the same rows."""
    events.write.mode("append").json(path)


def as_message(key: Column, changed_at: Column) -> Column:
    return F.concat_ws("|", key, changed_at.cast("string"))


def parse_message(message: Column) -> Column:
    """A struct (key, changed_at) of ``key|millis``: cut at the last bar, since keys hold bars too."""
    return F.struct(F.regexp_extract(message, r"^(.*)\|([^|]*)\z", 1).alias("key"), F.regexp_extract(message, r"^(.*)\|([^|]*)\z", 2).try_cast("bigint").alias("changed_at"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CHANGE_EVENT).json(path)


def consume(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``handle`` on each micro-batch. Events come at least once, so it has to be idempotent;
    a restart on the same checkpoint goes on where the last run ended."""
    return feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def invalidator(cache: LatestCache, latencies: str | None = None) -> Callable[[DataFrame, int], None]:
    """A handler that drops the changed keys from the cache, and records how late each event is."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        if latencies:
            late = batch.select("key", "changed_at", (F.unix_millis(F.current_timestamp()) - F.col("changed_at")).alias("latency_ms"), F.lit(batch_id).alias("batch_id"))
            late.write.mode("overwrite").parquet(f"{latencies}/batch={batch_id}")
        cache.invalidate(batch.select("key").distinct())

    return handle


def against_polling(latencies: DataFrame, interval_ms: int = 200, phase_ms: int = 0) -> DataFrame:
    """One row: how late the recorded deliveries were on average, and how late polls would have been.

    ``latencies`` has (changed_at, latency_ms). A poll runs every ``interval_ms``, at ``phase_ms``
    and so on, and sees a change at the first poll that is not before it.
    """
    wait = F.pmod(F.lit(phase_ms) - F.col("changed_at"), F.lit(interval_ms))
    return latencies.agg(F.count("*").alias("samples"), F.avg("latency_ms").alias("push_ms"), F.avg(wait).alias("poll_ms"))


def windowed_changes(feed: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Changes by event-time window, with late events beyond the watermark left out."""
    timed = feed.withColumn("at", F.timestamp_millis("changed_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count("*").alias("changes"), F.approx_count_distinct("key").alias("keys"))
