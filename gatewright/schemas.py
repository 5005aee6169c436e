"""Schemas: landing tables, vendor contracts, and the canonical quarantine and audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
MONEY = T.DecimalType(20, 6)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: The seven files of a gate corpus.
GATE_TABLES: dict[str, T.StructType] = {
    "security_master": _struct(instrument_id=_S, cusip=_S, isin=_S, instrument_name=_S, asset_class=_S, currency=_S, country=_S, sector=_S, benchmark_id=_S, maturity_date=T.DateType(), coupon_rate=MONEY, source_file=_S, source_row=_I),
    "pricing": _struct(instrument_id=_S, price_date=T.DateType(), price=MONEY, currency=_S, source_file=_S, source_row=_I),
    "positions": _struct(fund_id=_S, instrument_id=_S, position_date=T.DateType(), quantity=MONEY, market_value=MONEY, local_currency=_S, source_file=_S, source_row=_I),
    "funds": _struct(fund_id=_S, fund_name=_S, nav_date=T.DateType(), reported_nav=MONEY, source_file=_S, source_row=_I),
    "fx_rates": _struct(currency_code=_S, rate_date=T.DateType(), fx_rate_to_base=MONEY, source_file=_S, source_row=_I),
    "ref_benchmarks": _struct(benchmark_id=_S, benchmark_name=_S),
    "ref_currency": _struct(currency_code=_S, currency_name=_S),
}

#: Columns of a vendor feed file, and those it must have.
FEED_COLUMNS = ("instrument_id", "as_of_date", "received_at", "currency", "value1", "value2", "status", "region", "vendor", "schema_name")
FEED_REQUIRED = ("instrument_id", "as_of_date", "vendor", "schema_name")
VENDOR_RECORD = _struct(source_file=_S, source_row=_I, vendor=_S, schema_name=_S, instrument_id=_S, as_of_date=_S, received_at=_S, currency=_S, value1=_S, value2=_S, declared_column_count=_I, actual_column_count=_I, missing_required_column=_B)

#: Columns of a daily file, and of the records made from it.
DAILY_COLUMNS = ("as_of_date", "instrument_id", "value1", "value2", "currency", "source_vendor")
DAILY_RECORD = _struct(as_of_date=_S, instrument_id=_S, value1=_D, value2=_D, currency=_S, source_vendor=_S, schema=_S, source_file=_S, source_row=_I, asset_class=_S, allow_negative_value1=_B, value1_min=_D, value1_max=_D)
FILE_MANIFEST = _struct(schema=_S, file_name=_S, row_count=_L)

SNAPSHOT = T.MapType(_S, _S)
QUARANTINE = _struct(quarantine_id=_S, rule_name=_S, rule_category=_S, owner_name=_S, level=_S, source_file=_S, source_row=_L, column_name=_S, detail=_S, snapshot=SNAPSHOT, run_id=_S, detected_at=T.TimestampType())
AUDIT = _struct(quarantine_id=_S, rule_name=_S, snapshot=SNAPSHOT, decision=_S, run_id=_S, created_at=T.TimestampType())
VINTAGE = _struct(key=_S, recorded_at=T.TimestampType(), seq=_L, payload=SNAPSHOT)
CHANGE_EVENT = _struct(key=_S, changed_at=_L)

#: Owners of the rule categories: fixed values.
OWNERS = {
    "pricing": "Pricing Operations - D. Alvarez",
    "security_master": "Security Master - R. Chen",
    "position_fund": "Fund Accounting - T. Osei",
}

#: Asset classes of the feeds with the upper bound of value1: fixed values.
FEED_CLASSES = {"Equity": 10000.0, "FixedIncome": 200.0, "FX": 10.0, "Commodity": 5000.0, "Derivative": 1000000.0}
DAILY_CLASSES = ("equity", "bond", "etf", "option", "cash", "future", "swap")
DAILY_REGIONS = ("us", "eu", "apac", "latam", "emea")


def feed_schemas(n: int = 40) -> list[tuple[str, str, float, bool]]:
    """(schema_name, asset_class, upper bound of value1, negatives allowed) of the feed contracts."""
    classes = list(FEED_CLASSES)
    return [(f"{c.lower()}_vendor_feed_{i + 1}", c, FEED_CLASSES[c], c == "Derivative") for i in range(n) for c in [classes[i % len(classes)]]]


def daily_schemas() -> list[tuple[str, str, bool, float, float]]:
    """(schema, asset_class, negatives allowed, least value1, largest value1) of the daily contracts."""
    return [(f"{c}_{r}", c, c in ("swap", "future"), -1000.0 if c in ("swap", "future") else 0.0, 100000.0) for c in DAILY_CLASSES for r in DAILY_REGIONS]


def feed_schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(feed_schemas(), _struct(schema_name=_S, asset_class=_S, value1_upper_bound=_D, allow_negative_value1=_B))


def daily_schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(daily_schemas(), _struct(schema=_S, asset_class=_S, allow_negative_value1=_B, value1_min=_D, value1_max=_D))


def owner_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OWNERS.items()), _struct(rule_category=_S, owner_name=_S))
