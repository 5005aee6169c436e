"""Append-only vintages: as-of and latest reads, counts, and a read-through latest table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import VINTAGE
from ..sources.staging import stored

#: How long a cached payload counts: a fixed value.
TTL_SECONDS = 30.0


def restate(vintages: DataFrame, new: DataFrame) -> DataFrame:
    """The vintages with new ones appended; nothing is changed."""
    return vintages.unionByName(new)


def as_of(vintages: DataFrame, at: Column | None = None, keys: tuple[str, ...] = ("key",), order: str = "recorded_at", seq: str = "seq") -> DataFrame:
    """The vintage of each key with the greatest ``recorded_at`` not after ``at`` (of all, if None).

    Of equal ones the first inserted counts. A key without such a vintage has no row.
    """
    known = vintages if at is None else vintages.where(F.col(order) <= at)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.asc(seq)))
    return known.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest(vintages: DataFrame, **options) -> DataFrame:
    return as_of(vintages, None, **options)


def vintage_counts(vintages: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    return vintages.groupBy(*keys).agg(F.count("*").alias("vintages"))


def key_count(vintages: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    return vintages.agg(F.countDistinct(*keys).alias("keys"))


def restated_price(current: DataFrame, instrument_id: str, price_date: str, price: str, recorded_at: Column, seq: Column) -> DataFrame:
    """A new vintage of a price. The fields of the latest payload that are not restated are kept."""
    key = f"PRICE|{instrument_id}|{price_date}"
    new = F.create_map(F.lit("instrument_id"), F.lit(instrument_id), F.lit("price_date"), F.lit(price_date), F.lit("price"), F.lit(price))
    prior = latest(current.where(F.col("key") == key)).select(F.col("payload").alias("_old"))
    one = current.sparkSession.range(1).select(F.lit(key).alias("key"), recorded_at.alias("recorded_at"), seq.cast("bigint").alias("seq"))
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("instrument_id", "price_date", "price"))
    return one.join(prior, F.lit(True), "left").select("key", "recorded_at", "seq", F.map_concat(kept, new).alias("payload"))


class LatestCache:
    """A read-through cache of latest payloads: filled on a miss, stale until invalidated or timed out.

    Its state is an append-only log in a folder, so any process that opens the folder sees it, and
    it is of any size. A miss appends the payload that was read, an invalidation a mark; a read that
    finds all its keys writes nothing. The last entry of a key counts, for ``ttl_seconds``.
    """

    _LOG = T.StructType([*VINTAGE.fields, T.StructField("logged_at", T.LongType()), T.StructField("live", T.BooleanType())])

    def __init__(self, path: str, ttl_seconds: float = TTL_SECONDS, clock: Callable[[], int] = time.time_ns):
        self.path, self.ttl, self.clock = path, int(ttl_seconds * 1e9), clock

    def _entries(self, spark: SparkSession) -> DataFrame:
        """The live entry of each key."""
        log = stored(spark, self.path)
        if log is None:
            return spark.createDataFrame([], self._LOG)
        log = spark.read.schema(self._LOG).parquet(self.path)
        last = log.groupBy("key").agg(F.max_by(F.struct(*self._LOG.fieldNames()), F.struct("logged_at", ~F.col("live"))).alias("e")).select("e.*")
        return last.where(F.col("live") & (F.col("logged_at") > self.clock() - self.ttl))

    def _append(self, rows: DataFrame, live: bool) -> None:
        whole = rows.withColumns({"logged_at": F.lit(self.clock()), "live": F.lit(live)})
        whole.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._LOG.fields]).write.mode("append").parquet(self.path)

    def read(self, vintages: DataFrame, keys: DataFrame) -> DataFrame:
        """The payloads of the asked keys: cached ones as they were cached, others from the store."""
        spark, asked = vintages.sparkSession, keys.select("key").distinct()
        missing = asked.join(self._entries(spark), "key", "left_anti")
        found = latest(vintages.join(missing, "key", "left_semi")).select(*VINTAGE.fieldNames())
        if not found.isEmpty():
            self._append(found, True)
        return self._entries(spark).join(asked, "key", "left_semi").select(*VINTAGE.fieldNames())

    def invalidate(self, keys: DataFrame) -> None:
        """Drop the keys, cached or not: dropping twice is as good as once."""
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in VINTAGE.fields if f.name != "key"]
        self._append(keys.select("key").distinct().select("key", *none), False)

    def is_cached(self, spark: SparkSession, key: str) -> bool:
        return not self._entries(spark).where(F.col("key") == key).isEmpty()


def latest_of(vintages: DataFrame, kind: str, *parts: str) -> DataFrame:
    """The latest vintage of one master (``SM``), price (``PRICE``) or position (``POS``); no row if unknown."""
    return latest(vintages.where(F.col("key") == "|".join((kind, *parts))))


def restate_price(vintages: DataFrame, instrument_id: str, price_date: str, price: str, recorded_at: Column, seq: Column) -> tuple[DataFrame, int, int]:
    """The vintages with a restated price, and how many vintages its key had before and has after."""
    new = restated_price(vintages, instrument_id, price_date, price, recorded_at, seq)
    after = restate(vintages, new)
    same = F.col("key") == f"PRICE|{instrument_id}|{price_date}"
    return after, vintages.where(same).count(), after.where(same).count()
