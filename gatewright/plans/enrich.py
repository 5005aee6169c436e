"""Context fields of the rules, added to an anchor table by joins and windows, only where needed.

No join is hinted: a side is broadcast where Catalyst or AQE knows its size to be below the
session's threshold, and shuffled beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import BASELINE_ROWS

Tables = dict[str, DataFrame]


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that with the largest order: a dimension that cannot fan out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _flagged(df: DataFrame, other: DataFrame, on: dict[str, str], flag: str) -> DataFrame:
    """``df`` with a flag that says whether the key occurs in ``other``."""
    keys = other.select(*[F.col(theirs).alias(f"_k_{ours}") for ours, theirs in on.items()]).distinct().withColumn(flag, F.lit(True))
    condition = [F.col(ours) == F.col(f"_k_{ours}") for ours in on]
    return df.join(keys, condition, "left").drop(*[f"_k_{ours}" for ours in on])


def _master(df: DataFrame, tables: Tables, fields: dict[str, str]) -> DataFrame:
    """Fields of the security master; of several rows of an instrument the last counts."""
    master = last_by(tables["security_master"], "instrument_id", "source_row")
    picked = master.select(F.col("instrument_id").alias("_m"), *[F.expr(e).alias(name) for name, e in fields.items()])
    return df.join(picked, F.col("instrument_id") == F.col("_m"), "left").drop("_m")


def enrich_pricing(df: DataFrame, tables: Tables, needs: set[str], run_date: str) -> DataFrame:
    by_instrument = Window.partitionBy("instrument_id")
    if "_latest_date" in needs:
        df = df.withColumn("_latest_date", F.max("price_date").over(by_instrument))
    if "_prev_price" in needs:
        earlier = by_instrument.orderBy("price_date", "source_row").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_prev_price", F.last(F.when(F.col("price") > 0, F.col("price")), ignorenulls=True).over(earlier))
    fields = {"_instrument_exists": "true", "_security_master_currency": "currency", "_maturity_date": "case when asset_class = 'Bond' then maturity_date end"}
    if needs & set(fields):
        df = _master(df, tables, {k: v for k, v in fields.items() if k in needs})
    if "_dataset_max_date" in needs:
        df = df.crossJoin(tables["pricing"].agg(F.max("price_date").alias("_dataset_max_date")))  # one row
    return df.withColumn("_as_of_today", F.to_date(F.lit(run_date))) if "_as_of_today" in needs else df


def enrich_security_master(df: DataFrame, tables: Tables, needs: set[str], run_date: str) -> DataFrame:
    if "_cusip_count" in needs:
        # Rows without a cusip are each a group of their own, so that they do not meet in one task.
        alone = F.when(F.col("cusip").isNull(), F.struct("source_file", "source_row", "instrument_id"))
        same = Window.partitionBy("cusip", alone)
        df = df.withColumn("_cusip_count", F.when(F.col("cusip").isNotNull(), F.count("*").over(same)))
    if "_has_any_price" in needs:
        df = _flagged(df, tables["pricing"], {"instrument_id": "instrument_id"}, "_has_any_price")
    if "_benchmark_resolves" in needs:
        df = _flagged(df, tables["ref_benchmarks"], {"benchmark_id": "benchmark_id"}, "_benchmark_resolves")
    if "_currency_is_valid_iso" in needs:
        df = _flagged(df, tables["ref_currency"], {"currency": "currency_code"}, "_currency_is_valid_iso")
    return df


def enrich_positions(df: DataFrame, tables: Tables, needs: set[str], run_date: str) -> DataFrame:
    if "_key_count" in needs:
        df = df.withColumn("_key_count", F.count("*").over(Window.partitionBy("fund_id", "instrument_id", "position_date")))
    fields = {"_instrument_exists": "true", "_security_master_asset_class": "asset_class"}
    if needs & set(fields):
        df = _master(df, tables, {k: v for k, v in fields.items() if k in needs})
    if "_fx_rate_exists" in needs:
        df = _flagged(df, tables["fx_rates"], {"local_currency": "currency_code", "position_date": "rate_date"}, "_fx_rate_exists")
    if "_price_exists_for_date" in needs:
        df = _flagged(df, tables["pricing"], {"instrument_id": "instrument_id", "position_date": "price_date"}, "_price_exists_for_date")
    return df


def enrich_funds(df: DataFrame, tables: Tables, needs: set[str], run_date: str) -> DataFrame:
    if "_true_total" not in needs:
        return df
    totals = tables["positions"].groupBy(F.col("fund_id").alias("_f"), F.col("position_date").alias("_d")).agg(F.sum("market_value").alias("_sum"))
    joined = df.join(totals, (F.col("fund_id") == F.col("_f")) & (F.col("nav_date") == F.col("_d")), "left")
    # A fund-date without positions has holdings of 0, so a reported value other than 0 is off.
    return joined.withColumn("_true_total", F.coalesce("_sum", F.lit(0).cast("decimal(18,2)"))).drop("_f", "_d", "_sum")


def _with_key_figures(df: DataFrame, wanted: set[str]) -> DataFrame:
    """Figures of a record's key over its vendors, and how often its vendor delivers it.

    Records are counted by vendor and key before they are shuffled, the vendors of a key meet in a
    window of as many rows as there are vendors, and one join brings the figures back. So records
    whose key is blank, however many, are never one task's: a join's large partition is split.
    """
    key = ("schema_name", "instrument_id", "as_of_date")
    value = F.col("value1").try_cast("double")
    figures = {
        "_first_vendor": F.min("vendor"),
        "_last_vendor": F.max("vendor"),
        "_value_max": F.max("_most"),
        "_value_min": F.min("_least"),
    }
    each = df.groupBy("vendor", *key).agg(F.count("*").alias("_row_key_count"), F.max(value).alias("_most"), F.min(value).alias("_least"))
    same = Window.partitionBy(*key)
    each = each.withColumns({name: f.over(same) for name, f in figures.items() if name in wanted})
    each = each.select(*[F.col(c).alias(f"_k_{c}") for c in ("vendor", *key)], *sorted(wanted))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("vendor", *key)]
    return df.join(each, on, "left").drop(*[f"_k_{c}" for c in ("vendor", *key)])


def enrich_vendor_record(df: DataFrame, tables: Tables, needs: set[str], run_date: str) -> DataFrame:
    by_key = needs & {"_first_vendor", "_last_vendor", "_value_max", "_value_min", "_row_key_count"}
    if by_key:
        df = _with_key_figures(df, by_key)
    if "_instrument_known" in needs:
        df = _flagged(df, tables["instrument_master"], {"instrument_id": "instrument_id"}, "_instrument_known")
    if needs & {"_allow_negative_value1", "_value1_upper_bound"}:
        bounds = tables["schema_bounds"].select(F.col("schema_name").alias("_s"), F.col("allow_negative_value1").alias("_allow_negative_value1"), F.col("value1_upper_bound").alias("_value1_upper_bound"))
        df = df.join(bounds, F.col("schema_name") == F.col("_s"), "left").drop("_s")
    if needs & {"_file_rows", "_median_rows"}:
        files = tables["vendor_record"].groupBy(F.col("source_file").alias("_file"), F.col("schema_name").alias("_s")).agg(F.count("*").alias("_file_rows"))
        medians = files.where(F.col("_file_rows") >= BASELINE_ROWS).groupBy(F.col("_s").alias("_ms")).agg(F.expr("percentile(_file_rows, 0.5)").alias("_median_rows"))
        sized = files.join(medians, F.col("_s") == F.col("_ms"), "left").drop("_ms")
        df = df.join(sized, (F.col("source_file") == F.col("_file")) & (F.col("schema_name") == F.col("_s")), "left").drop("_file", "_s")
    return df.withColumn("_run_date", F.to_date(F.lit(run_date))) if "_run_date" in needs else df


def enrich_vendor_records(df: DataFrame, tables: Tables, needs: set[str], run_date: str) -> DataFrame:
    if needs & {"_first_row", "_last_row"}:
        same = Window.partitionBy("schema", "source_file", "instrument_id")
        df = df.withColumns({"_first_row": F.min("source_row").over(same), "_last_row": F.max("source_row").over(same)})
    return df


def _as_is(df: DataFrame, tables: Tables, needs: set[str], run_date: str) -> DataFrame:
    return df


ENRICH = {
    "pricing": enrich_pricing,
    "security_master": enrich_security_master,
    "positions": enrich_positions,
    "funds": enrich_funds,
    "vendor_record": enrich_vendor_record,
    "vendor_records": enrich_vendor_records,
    "file_manifest": _as_is,
    "schema_counts": _as_is,
}


def schema_counts(manifest: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Files of each schema. With the expected schemas given, one without any file counts 0."""
    counts = manifest.groupBy("schema").agg(F.count("*").alias("file_count"))
    if expected is None:
        return counts
    names = expected.select(F.col("schema").alias("_n")).distinct()
    return names.join(counts, F.col("_n") == F.col("schema"), "left").select(F.col("_n").alias("schema"), F.coalesce("file_count", F.lit(0)).alias("file_count"))
