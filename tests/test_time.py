"""Bitemporal reads, P&L, the change feed, percentiles and scalar helpers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gatewright.functions import values
from gatewright.operators import bitemporal, compare, pnl
from gatewright.schemas import VINTAGE
from gatewright.sources import corpus, files
from gatewright.streaming import changefeed


def vintages(spark, *rows):
    return spark.createDataFrame([(k, at, seq, {"price": p}) for k, at, seq, p in rows], "key string, at string, seq long, payload map<string,string>").select("key", F.to_timestamp("at").alias("recorded_at"), "seq", "payload")


def test_as_of_boundaries_and_ties(spark):
    v = vintages(spark, ("K", "2026-01-01 00:00:00", 1, "100.00"), ("K", "2026-01-02 00:00:00", 2, "107.50"), ("T", "2026-01-01 00:00:00", 5, "first"), ("T", "2026-01-01 00:00:00", 6, "second"))
    price = lambda df, k: [r["payload"]["price"] for r in df.where(F.col("key") == k).collect()]
    at = lambda t: bitemporal.as_of(v, F.to_timestamp(F.lit(t)))
    assert price(at("2025-12-31 23:59:59"), "K") == []
    assert price(at("2026-01-01 00:00:00"), "K") == ["100.00"]
    assert price(at("2026-01-01 23:59:59"), "K") == ["100.00"]
    assert price(at("2026-01-02 00:00:00"), "K") == ["107.50"]
    assert price(bitemporal.latest(v), "K") == ["107.50"] and price(bitemporal.latest(v), "T") == ["first"]
    assert {tuple(r) for r in bitemporal.vintage_counts(v).collect()} == {("K", 2), ("T", 2)}
    assert bitemporal.key_count(v).first()[0] == 2


def test_restating_a_price_keeps_other_fields(spark):
    tables, _ = corpus.gate_corpus(spark, days=3)
    loaded = files.load_vintages({n: tables[n].limit(5) for n in ("security_master", "pricing", "positions")}, F.to_timestamp(F.lit("2026-08-28")))
    row = tables["pricing"].limit(5).first()
    new = bitemporal.restated_price(loaded, row["instrument_id"], str(row["price_date"]), "1.23", F.to_timestamp(F.lit("2026-08-29")), F.lit(99))
    after = bitemporal.latest(bitemporal.restate(loaded, new)).where(F.col("key") == new.first()["key"]).first()["payload"]
    assert after["price"] == "1.23" and after["currency"] == row["currency"]
    assert bitemporal.restate(loaded, new).count() == loaded.count() + 1


def test_cache_is_stale_until_invalidated(spark, tmp_path):
    cache = bitemporal.LatestCache(str(tmp_path / "cache"))
    keys = spark.createDataFrame([("K",), ("none",)], "key string")
    v = vintages(spark, ("K", "2026-01-01 00:00:00", 1, "1"))
    assert [r["payload"]["price"] for r in cache.read(v, keys).collect()] == ["1"]
    moved = v.unionByName(vintages(spark, ("K", "2026-01-02 00:00:00", 2, "2")))
    assert cache.is_cached(spark, "K") and [r["payload"]["price"] for r in cache.read(moved, keys).collect()] == ["1"]
    cache.invalidate(keys)
    assert not cache.is_cached(spark, "K")
    assert [r["payload"]["price"] for r in cache.read(moved, keys).collect()] == ["2"]


def test_cache_state_is_in_its_folder_and_times_out(spark, tmp_path):
    now = [1_000_000_000]
    open_cache = lambda: bitemporal.LatestCache(str(tmp_path / "cache"), ttl_seconds=30, clock=lambda: now[0])
    keys = spark.createDataFrame([("K",), ("L",)], "key string")
    v = vintages(spark, ("K", "2026-01-01 00:00:00", 1, "1"), ("L", "2026-01-01 00:00:00", 2, "5"))
    open_cache().read(v, keys).count()
    files_before = len(list((tmp_path / "cache").glob("*.parquet")))
    moved = v.unionByName(vintages(spark, ("K", "2026-01-02 00:00:00", 3, "2")))
    price = lambda: {r["key"]: r["payload"]["price"] for r in open_cache().read(moved, keys).collect()}
    now[0] += 29 * 10**9
    assert open_cache().is_cached(spark, "K") and price() == {"K": "1", "L": "5"}  # another opener sees what was cached
    assert len(list((tmp_path / "cache").glob("*.parquet"))) == files_before  # a read of cached keys writes nothing
    now[0] += 2 * 10**9
    assert not open_cache().is_cached(spark, "K") and price() == {"K": "2", "L": "5"}
    open_cache().invalidate(keys.where("key = 'L'"))
    assert open_cache().is_cached(spark, "K") and not open_cache().is_cached(spark, "L")


def test_push_against_polling(spark):
    late = spark.createDataFrame([(0, 2), (50, 4), (200, 6)], "changed_at long, latency_ms long")
    assert tuple(changefeed.against_polling(late, interval_ms=200).first()) == (3, 4.0, 50.0)
    assert tuple(changefeed.against_polling(late, interval_ms=200, phase_ms=60).first()) == (3, 4.0, (60 + 10 + 60) / 3)


def test_change_feed_invalidates_once(spark, tmp_path):
    feed, ckpt, late = (str(tmp_path / x) for x in ("feed", "ckpt", "late"))
    cache = bitemporal.LatestCache(str(tmp_path / "cache"))
    v = vintages(spark, ("PRICE|I|2026", "2026-01-01 00:00:00", 1, "1"), ("B", "2026-01-01 00:00:00", 1, "1"))
    cache.read(v, v.select("key")).count()
    changefeed.publish(changefeed.change_events(v.where("key <> 'B'")), feed)
    for _ in range(2):  # the second start finds nothing new
        changefeed.consume(changefeed.read_feed(spark, feed), changefeed.invalidator(cache, late), ckpt).awaitTermination()
    assert not cache.is_cached(spark, "PRICE|I|2026") and cache.is_cached(spark, "B")
    assert spark.read.parquet(late).count() == 1
    changefeed.publish(changefeed.change_events(v.where("key = 'B'")), feed)
    changefeed.consume(changefeed.read_feed(spark, feed), changefeed.invalidator(cache, late), ckpt).awaitTermination()
    assert not cache.is_cached(spark, "B") and spark.read.parquet(late).count() == 2


def test_messages_and_windows(spark, tmp_path):
    message = spark.range(1).select(changefeed.parse_message(changefeed.as_message(F.lit("PRICE|I|2026-01-01"), F.lit(17).cast("long"))).alias("m")).first()["m"]
    assert tuple(message) == ("PRICE|I|2026-01-01", 17)
    spark.createDataFrame([("a", 1_000), ("b", 2_000), ("a", 61_000), ("z", 10_000_000)], "key string, changed_at long").write.json(str(tmp_path / "f"))
    query = changefeed.windowed_changes(changefeed.read_feed(spark, str(tmp_path / "f"))).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["changes"] for r in spark.table("windows").collect()) == [1, 1, 2]


def test_pnl_ties_out_on_a_dense_grid_only(spark):
    tables, _ = corpus.gate_corpus(spark, days=5)
    out = pnl.tie_out(tables["positions"])
    assert out.count() == 5 * 4 and out.where("mismatch").count() == 0
    gaps = tables["positions"].where(~((F.col("instrument_id") == "INS-0001") & (F.dayofmonth("position_date") % 2 == 0)))
    assert pnl.tie_out(gaps).where("mismatch").count() > 0
    assert pnl.tie_out(pnl.densified(gaps)).where("mismatch").count() == 0


def test_nearest_rank_and_medians(spark):
    df = spark.createDataFrame([("g", v) for v in (5, 1, 4, 2, 3, None)] + [("h", 7)], "g string, v int")
    got = {r["g"]: tuple(r)[1:] for r in compare.nearest_rank(df, "v", {"p50": 0.5, "p99": 0.99}, ("g",)).collect()}
    assert got == {"g": (3, 5, 5, 3.0), "h": (7, 7, 7, 7.0)}
    odd = spark.createDataFrame([(1,), (2,), (10,), (20,)], "v int").withColumn("g", F.lit(1))
    assert compare.median_of(odd, "v", ("g",)).first()["median"] == 6.0
    assert compare.same_rows(df, df) and not compare.same_rows(df, df.limit(3))
    assert compare.checksum(df).first()["n"] == 7


@pytest.mark.parametrize(("text", "want"), [("2026-01-05", "2026-01-05"), ("2026-1-5", None), ("2026", None), ("2026-13-01", None), ("", None), (None, None)])
def test_strict_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(values.iso_date(F.col("x"))).first()[0]
    assert (str(got) if got else None) == want


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(" ", "1d", 2.0), ("", "x", 2.5), (None, "7", 1e300)], "a string, b string, c double")
    got = df.select(values.is_missing(F.col("a")), values.is_blank(F.col("a")), values.is_trimmed_empty(F.col("a")), values.number(F.col("b"), -1.0), values.is_whole(F.col("c")), values.is_distinct(F.col("a"), F.lit(None))).collect()
    assert [tuple(r) for r in got] == [(False, True, True, 1.0, True, True), (True, True, True, -1.0, False, True), (True, True, True, 7.0, True, False)]
    assert [str(d) for d in spark.range(1).select(values.business_days("2026-08-28", "2026-09-01")).first()[0]] == ["2026-08-28", "2026-08-31", "2026-09-01"]
    assert spark.createDataFrame([(None, 1)], "a string, b int").select(values.row_json("a", "b")).first()[0] == '{"a":null,"b":1}'
    assert corpus.business_days_ending("2026-08-31", 3) == ["2026-08-27", "2026-08-28", "2026-08-31"]
    assert Decimal("0.01") == Decimal(pnl.TOLERANCE) and VINTAGE.fieldNames()[0] == "key"
