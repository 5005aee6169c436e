"""Generators of clean and defective corpora, as DataFrames over ``spark.range``.

Every value is a function of the row's number and the seed, so a corpus is the same on any
cluster, and defects are known rows: a manifest comes from the same choices that inject them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.rules import DAILY_DATE, DAILY_FILES, DAILY_ROWS
from ..schemas import FEED_COLUMNS, daily_schemas, feed_schemas

#: Make-up of the simulated corpus: fixed values.
CLASS_COUNTS = {"Equity": 220, "Bond": 150, "ETF": 60, "Option": 30, "Cash": 20}
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD")
FX_BASE = {"EUR": 1.08, "GBP": 1.27, "JPY": 0.0068, "CAD": 0.74}
SECTORS = ("Software", "Medicine", "Banking", "Power", "Retail", "Machinery", "Water", "Mining")
BENCHMARKS = ("BM-LARGE", "BM-SMALL", "BM-ATLANTIC", "BM-PACIFIC")
COUNTRIES = ("US", "GB", "DE", "JP", "CA")
FUNDS = ("F01", "F02", "F03", "F04", "F05")
N_INSTRUMENTS = sum(CLASS_COUNTS.values())
NUMBERING_BLOCK = 100_000


def _unit(seed: int, *parts) -> Column:
    """A number in [0, 1) that is a function of the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def _one_of(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def business_days_ending(end: str, n: int) -> list[str]:
    """The last n weekdays up to ``end``."""
    day, out = dt.date.fromisoformat(end), []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day.isoformat())
        day -= dt.timedelta(days=1)
    return out[::-1]


def _master(spark: SparkSession, seed: int, end: str) -> DataFrame:
    i, asset_class, below = F.col("i"), F.lit(None).cast("string"), 0
    for name, n in CLASS_COUNTS.items():
        asset_class = F.when((i > below) & (i <= below + n), name).otherwise(asset_class)
        below += n
    df = spark.range(1, N_INSTRUMENTS + 1).select(F.col("id").cast("int").alias("i")).withColumn("asset_class", asset_class)
    is_class = lambda *names: F.col("asset_class").isin(*names)
    return df.select(
        "i",
        F.format_string("INS-%04d", i).alias("instrument_id"),
        F.format_string("CUS%06d", i).alias("cusip"),
        F.format_string("US%09d1", i).alias("isin"),
        F.format_string("%s Instrument %04d", "asset_class", i).alias("instrument_name"),
        "asset_class",
        F.when(is_class("Equity"), _one_of(CURRENCIES, _unit(seed, F.lit("ccy"), i))).otherwise("USD").alias("currency"),
        _one_of(COUNTRIES, _unit(seed, F.lit("country"), i)).alias("country"),
        F.when(is_class("Equity"), _one_of(SECTORS, _unit(seed, F.lit("sector"), i))).alias("sector"),
        F.when(is_class("Equity", "ETF"), _one_of(BENCHMARKS, _unit(seed, F.lit("bm"), i))).alias("benchmark_id"),
        F.when(is_class("Bond"), F.date_add(F.to_date(F.lit(end)), (365 * (2 + F.floor(14 * _unit(seed, F.lit("mat"), i)))).cast("int"))).alias("maturity_date"),
        F.when(is_class("Bond"), F.round(0.01 + 0.055 * _unit(seed, F.lit("cpn"), i), 4)).cast("decimal(20,6)").alias("coupon_rate"),
    )


def _price(seed: int, i: Column, d: Column) -> Column:
    """A price that moves less than 2% a day: a slow wave for each instrument with small noise."""
    base = 10 + 490 * _unit(seed, F.lit("base"), i)
    wave = 1 + 0.1 * F.sin(d / 20.0 + 6 * _unit(seed, F.lit("phase"), i)) + 0.005 * (_unit(seed, F.lit("noise"), i, d) - 0.5)
    return F.round(base * wave, 4).cast("decimal(20,6)")


#: Instruments (by number) and days that each defect takes: two for each rule, three pairs of cusips.
DEFECTS: dict[str, tuple] = {
    "missing_price": (11, 12),
    "stale_price": (21, 22),
    "future_dated_price": (31, 32),
    "negative_price": (41, 42),
    "zero_price": (51, 52),
    "price_band_breach": (61, 62),
    "price_currency_mismatch": (71, 72),
    "missing_benchmark": (81, 82),
    "duplicate_identifier": ((91, 92), (93, 94), (95, 96)),
    "missing_asset_class": (101, 102),
    "missing_currency_code": (111, 112),
    "invalid_currency_code": (121, 122),
    "missing_sector_for_equity": (131, 132),
    "missing_maturity_date_for_bond": (231, 232),
    "coupon_rate_out_of_range_for_bond": (241, 242),
    "matured_bond_still_priced": (251, 252),
    "holdings_to_nav_tie_out": (1, 2),
    "orphan_position": (141, 142),
    "negative_position_quantity": (151, 152),
    "duplicate_position_row": (161, 162),
    "fx_rate_missing_for_nonbase_currency": (171, 172),
    "position_date_mismatch": (261, 262),
}
#: The day (from 0) of defects in prices and positions, and days cut off a stale series.
DEFECT_DAY, STALE_CUT = 10, 6


def number_rows(df: DataFrame, order: str, file: str) -> DataFrame:
    """``source_file`` and ``source_row``: the place by the dense number ``order``, the first being row 2.

    Rows are numbered in blocks of ``order``, and the blocks laid end to end, so no task sorts all.
    """
    block = F.floor(F.col(order) / NUMBERING_BLOCK).alias("_block")
    blocks = df.groupBy(block).agg(F.count("*").alias("_n"))
    before = blocks.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = df.withColumn("_block", F.floor(F.col(order) / NUMBERING_BLOCK)).join(before, "_block")
    at = F.row_number().over(Window.partitionBy("_block").orderBy(order, *[c for c in ("_copy",) if c in df.columns]))
    return placed.withColumns({"source_file": F.lit(file), "source_row": (F.col("_before") + at + 1).cast("int")}).drop("_block", "_before")


def gate_corpus(spark: SparkSession, *, days: int = 30, end: str = "2026-08-28", seed: int = 42, defects: bool = False) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The seven tables of a clean or defective corpus, and the manifest of its 45 defects."""
    calendar = business_days_ending(end, days)
    day_of = F.element_at(F.array(*[F.lit(d) for d in calendar]), F.col("d").cast("int") + 1).cast("date")
    in_ = lambda rule: F.col("i").isin(*DEFECTS[rule]) if defects else F.lit(False)
    on_day = F.col("d") == DEFECT_DAY
    master = _master(spark, seed, end)
    grid = spark.range(N_INSTRUMENTS * days).select((F.col("id") / days).cast("int").alias("i0"), (F.col("id") % days).cast("int").alias("d"), F.col("id").alias("n")).select((F.col("i0") + 1).alias("i"), "d", "n")
    plain = master.select("i", "instrument_id", F.col("currency").alias("ccy"))
    prices = grid.join(plain, "i").select("i", "d", "n", "instrument_id", day_of.alias("price_date"), _price(seed, F.col("i"), F.col("d")).alias("price"), F.col("ccy").alias("currency"))
    prices = prices.where(~(in_("missing_price") | (in_("stale_price") & (F.col("d") >= days - STALE_CUT))))
    altered = F.when(in_("negative_price") & on_day, -F.col("price")).when(in_("zero_price") & on_day, F.lit(0)).when(in_("price_band_breach") & on_day, F.col("price") * 5).otherwise(F.col("price")).cast("decimal(20,6)")
    pricing = prices.withColumns({"price": altered, "price_date": F.when(in_("future_dated_price") & on_day, F.lit("2099-01-01").cast("date")).otherwise(F.col("price_date")), "currency": F.when(in_("price_currency_mismatch") & on_day, F.when(F.col("currency") == "JPY", "EUR").otherwise("JPY")).otherwise(F.col("currency"))})
    security = master.withColumns(
        {
            "benchmark_id": F.when(~in_("missing_benchmark"), F.col("benchmark_id")),
            "cusip": F.coalesce(*[F.when(F.col("i").isin(a, b), F.format_string("CUSDUP%04d", F.lit(a))) for a, b in (DEFECTS["duplicate_identifier"] if defects else ())], F.col("cusip")),
            "asset_class": F.when(~in_("missing_asset_class"), F.col("asset_class")),
            "currency": F.when(in_("invalid_currency_code"), "ZZZ").when(~in_("missing_currency_code"), F.col("currency")),
            "sector": F.when(~in_("missing_sector_for_equity"), F.col("sector")),
            "maturity_date": F.when(in_("matured_bond_still_priced"), F.lit("2020-01-01").cast("date")).when(~in_("missing_maturity_date_for_bond"), F.col("maturity_date")),
            "coupon_rate": F.when(in_("coupon_rate_out_of_range_for_bond"), F.lit("-0.01").cast("decimal(20,6)")).otherwise(F.col("coupon_rate")),
        }
    )
    per_fund = N_INSTRUMENTS * days
    cells = spark.range(len(FUNDS) * per_fund).select(F.col("id").alias("n"), (F.col("id") / per_fund).cast("int").alias("f"), ((F.col("id") % per_fund) / N_INSTRUMENTS).cast("int").alias("d"), ((F.col("id") % N_INSTRUMENTS) + 1).cast("int").alias("i"))
    quantity = F.round(100 + 4900 * _unit(seed, F.lit("qty"), F.col("f"), F.col("i"), F.col("d")), 2).cast("decimal(20,6)")
    held = cells.join(plain, "i").select("n", "f", "d", "i", _one_of(FUNDS, (F.col("f") + 0.5) / len(FUNDS)).alias("fund_id"), "instrument_id", day_of.alias("position_date"), quantity.alias("quantity"), F.round(quantity * _price(seed, F.col("i"), F.col("d")), 2).cast("decimal(20,6)").alias("market_value"), F.col("ccy").alias("local_currency"))
    noise = 1 + 0.001 * (_unit(seed, F.lit("nav"), F.col("f"), F.col("d")) - 0.5)
    funds = held.groupBy("f", "d", "fund_id", F.col("position_date").alias("nav_date")).agg(F.sum("market_value").alias("total")).withColumn("n", F.col("f") * days + F.col("d"))
    off = F.when(F.col("n").isin(*[(k - 1) * days + DEFECT_DAY for k in DEFECTS["holdings_to_nav_tie_out"]]), 1.08).otherwise(1.0) if defects else F.lit(1.0)
    funds = funds.select("n", "fund_id", F.concat(F.lit("Simulated fund "), "fund_id").alias("fund_name"), "nav_date", F.round(F.col("total").cast("double") * noise * off, 2).cast("decimal(20,6)").alias("reported_nav"))
    here = (F.col("f") == F.col("i") % 2) & on_day
    flip = lambda c: F.when(in_("negative_position_quantity") & here, -F.col(c)).otherwise(F.col(c))
    positions = held.withColumns(
        {
            "instrument_id": F.when(in_("orphan_position") & here, "INS-9999").otherwise(F.col("instrument_id")),
            "quantity": flip("quantity"),
            "market_value": flip("market_value"),
            "local_currency": F.when(in_("fx_rate_missing_for_nonbase_currency") & here, "CHF").otherwise(F.col("local_currency")),
            "position_date": F.when(in_("position_date_mismatch") & here, F.lit("2000-01-01").cast("date")).otherwise(F.col("position_date")),
            "_copy": F.explode(F.when(in_("duplicate_position_row") & here, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    fx = spark.createDataFrame([(c, d, r * (1 + 0.005 * ((k * 37 + j * 11) % 21 - 10) / 10)) for j, d in enumerate(calendar) for k, (c, r) in enumerate(FX_BASE.items())], "currency_code string, rate_date string, rate double")
    numbered = {
        "security_master": number_rows(security.withColumn("n", F.col("i").cast("long")), "n", "security_master.csv"),
        "pricing": number_rows(pricing, "n", "pricing.csv"),
        "positions": number_rows(positions, "n", "positions.csv"),
        "funds": number_rows(funds, "n", "funds.csv"),
    }
    manifest = _gate_manifest(numbered) if defects else None
    tables = {k: v.drop("i", "d", "n", "f", "_copy") for k, v in numbered.items()}
    tables["fx_rates"] = fx.select("currency_code", F.col("rate_date").cast("date").alias("rate_date"), F.round("rate", 6).cast("decimal(20,6)").alias("fx_rate_to_base"))
    tables["ref_benchmarks"] = spark.createDataFrame([(b, f"{b} (simulated)") for b in BENCHMARKS], "benchmark_id string, benchmark_name string")
    tables["ref_currency"] = spark.createDataFrame([(c, c) for c in CURRENCIES], "currency_code string, currency_name string")
    return tables, manifest


def _gate_manifest(numbered: dict[str, DataFrame]) -> DataFrame:
    """(defect_id, rule_name, anchors) with lineage resolved from the numbered tables."""
    master, pricing, positions = numbered["security_master"], numbered["pricing"], numbered["positions"]
    on_day = F.col("d") == DEFECT_DAY
    at = {
        "stale_price": (pricing, None),
        "matured_bond_still_priced": (pricing, on_day),
        **{r: (pricing, on_day) for r in ("future_dated_price", "negative_price", "zero_price", "price_band_breach", "price_currency_mismatch")},
        **{r: (positions, on_day & (F.col("f") == F.col("i") % 2)) for r in ("orphan_position", "negative_position_quantity", "duplicate_position_row", "fx_rate_missing_for_nonbase_currency", "position_date_mismatch")},
    }
    parts = []
    anchors = F.array_sort(F.collect_list(F.struct(F.col("source_file"), F.col("source_row").cast("bigint").alias("source_row")))).alias("anchors")
    for rule, picks in DEFECTS.items():
        if rule == "holdings_to_nav_tie_out":
            days = numbered["funds"].agg(F.countDistinct("nav_date")).first()[0]
            rows = numbered["funds"].where(F.col("n").isin(*[(k - 1) * days + DEFECT_DAY for k in picks])).withColumn("g", F.col("n").cast("string"))
        elif rule == "duplicate_identifier":
            rows = master.where(F.col("i").isin(*[x for p in picks for x in p])).withColumn("g", F.col("cusip"))
        else:
            table, where = at.get(rule, (master, F.lit(True)))
            rows = table.where(F.col("i").isin(*picks))
            if where is None:  # the last row that is left of a stale series
                last = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("d")))
                rows = rows.withColumn("_last", last).where("_last = 1")
            else:
                rows = rows.where(where)
            rows = rows.withColumn("g", F.col("i").cast("string"))
        parts.append(rows.groupBy(F.concat_ws("-", F.lit(rule), "g").alias("defect_id")).agg(F.lit(rule).alias("rule_name"), anchors))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- vendor feeds ---------------------------------------------------------------------------

VENDORS = tuple(f"VENDOR_{x}" for x in ("ALPHA", "BETA", "GAMMA", "DELTA", "EPSILON", "ZETA"))
POOL = 2000
ROW_CHECKS = ("stale_feed", "missing_required_field", "value_out_of_range", "duplicate_row", "negative_value", "future_dated_record", "invalid_currency_code", "late_arriving_record", "orphan_instrument_reference", "type_mismatch")


def instrument_master(spark: SparkSession, pool: int = POOL) -> DataFrame:
    return spark.range(1, pool + 1).select(F.format_string("INST-%05d", "id").alias("instrument_id"))


def _feed_rows(spark: SparkSession, files: DataFrame, run_date: str, seed: int, pool: int = POOL) -> DataFrame:
    """Valid rows of files (source_file, schema_name, vendor, bound, n_rows, offset)."""
    rows = files.select("*", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("r"))
    u = lambda what: _unit(seed, F.lit(what), F.col("source_file"), F.col("r"))
    value = lambda what: F.round(u(what) * F.col("bound") * 0.8 + 1.0, 2).cast("string")
    return rows.select(
        "source_file",
        (F.col("r") + 1).alias("at"),
        F.format_string("INST-%05d", ((F.col("offset") + F.col("r")) % pool + 1).cast("int")).alias("instrument_id"),
        F.date_sub(F.to_date(F.lit(run_date)), 1).cast("string").alias("as_of_date"),
        F.lit(run_date).alias("received_at"),
        _one_of(("USD", "EUR", "GBP", "JPY", "CHF"), u("ccy")).alias("currency"),
        value("v1").alias("value1"),
        value("v2").alias("value2"),
        F.lit("ACTIVE").alias("status"),
        _one_of(("US", "EU", "APAC"), u("region")).alias("region"),
        "vendor",
        "schema_name",
        F.array(*map(F.lit, FEED_COLUMNS)).alias("header"),
    )


_FILE = "source_file string, schema_name string, vendor string, bound double, n_rows int, offset int"


def feed_corpus(spark: SparkSession, *, files_per_schema: int = 30, rows_per_file: int = 1000, run_date: str = "2026-10-05", seed: int = 7) -> DataFrame:
    """Rows of a clean feed corpus; ``sinks.write_named_csv`` makes files of them.

    The pool of instruments is large enough that no schema has one twice.
    """
    pool = max(POOL, files_per_schema * rows_per_file)
    files = [(f"{VENDORS[f % 6]}_{s}_{run_date}_{f:03d}.csv", s, VENDORS[f % 6], bound, rows_per_file, f * rows_per_file) for s, _, bound, _ in feed_schemas() for f in range(files_per_schema)]
    return _feed_rows(spark, spark.createDataFrame(files, _FILE), run_date, seed, pool)


def feed_defects(spark: SparkSession, *, files_per_schema: int = 6, rows_per_file: int = 150, run_date: str = "2026-10-05", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Rows of a corpus with 500 defects, and its manifest (check, source_file, source_row).

    36 defects of each of ten row checks are dealt over the main files, so that no schema has one
    twice that could be taken for another check; drift (2 x 40 rows), short files (20) and
    disagreeing vendors (40) have files of their own.
    """
    schemas = feed_schemas()
    main = [(f"{VENDORS[f % 6]}_{s}_{run_date}_defectmain.csv" if files_per_schema <= 6 else f"{VENDORS[f % 6]}_{s}_{run_date}_{f}_defectmain.csv", s, VENDORS[f % 6], bound, rows_per_file, (f * rows_per_file) % POOL) for s, _, bound, _ in schemas for f in range(files_per_schema)]
    plan: list[tuple[str, int, str]] = []
    others = [c for c in ROW_CHECKS if c != "negative_value"]
    skips = iter(others * 4)
    extra = 4  # schemas with two negative values, for those that allow them have none
    for i, (_, _, _, negatives) in enumerate(schemas):
        own = list(others)
        if not negatives:
            own += ["negative_value"] * (2 if extra > 0 else 1)
            for _ in range(2 if extra > 0 else 1):
                own.remove(next(skips))
            extra -= 1
        plan += [(main[i * files_per_schema + k % files_per_schema][0], 20 + 10 * (k // files_per_schema) + k, c) for k, c in enumerate(own)]
    chosen = spark.createDataFrame(plan, "source_file string, at int, check string")
    day = lambda n: F.date_add(F.to_date(F.lit(run_date)), n).cast("string")
    rows = _feed_rows(spark, spark.createDataFrame(main, _FILE), run_date, seed).join(chosen, ["source_file", "at"], "left")
    bounds = spark.createDataFrame([(s, b) for s, _, b, _ in schemas], "schema_name string, bound double")
    c = F.col("check")
    rows = rows.join(bounds, "schema_name").withColumns(
        {
            "as_of_date": F.when(c == "stale_feed", day(-10)).when(c == "late_arriving_record", day(-8)).when(c == "future_dated_record", day(5)).otherwise(F.col("as_of_date")),
            "instrument_id": F.when(c == "missing_required_field", "").when(c == "orphan_instrument_reference", "INST-99999").otherwise(F.col("instrument_id")),
            "value1": F.when(c == "value_out_of_range", (F.col("bound") * 5).cast("string")).when(c == "negative_value", "-100.0").when(c == "type_mismatch", "NOT_A_NUMBER").otherwise(F.col("value1")),
            "currency": F.when(c == "invalid_currency_code", "ZZZ").otherwise(F.col("currency")),
            "copy": F.explode(F.when(c == "duplicate_row", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    # A copied row comes right after its original and moves the rest of its file down by one.
    moved = F.sum("copy").over(Window.partitionBy("source_file").orderBy("at", "copy").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", (F.col("at") + moved).cast("int"))
    marks = rows.where(c.isNotNull() & ((c != "duplicate_row") | (F.col("copy") == 1))).select("check", "source_file", F.col("at").cast("bigint").alias("source_row"))
    columns = ["source_file", "at", *FEED_COLUMNS, "header"]

    special = [(f"{VENDORS[k % 6]}_{schemas[j][0]}_{run_date}_{tag}_{k}.csv", schemas[j][0], VENDORS[k % 6], schemas[j][2], 10, 1900 + 10 * k, tag) for j, tag, n in ((0, "drift_colcount", 4), (1, "drift_missingcol", 4), (2, "rowcount_anomaly", 2)) for k in range(n)]
    tags = spark.createDataFrame(special, _FILE + ", tag string")
    odd = _feed_rows(spark, tags.drop("tag"), run_date, seed).join(tags.select("source_file", "tag"), "source_file")
    odd = odd.withColumns({"unexpected_extra_column": F.concat(F.lit("extra-"), F.col("at") - 1), "header": F.when(F.col("tag") == "drift_colcount", F.array_append("header", "unexpected_extra_column")).when(F.col("tag") == "drift_missingcol", F.array_remove("header", "as_of_date")).otherwise(F.col("header"))})
    names = {"drift_colcount": "schema_drift_column_count", "drift_missingcol": "schema_drift_missing_column", "rowcount_anomaly": "row_count_anomaly"}
    odd_marks = odd.select(F.coalesce(*[F.when(F.col("tag") == t, n) for t, n in names.items()]).alias("check"), "source_file", F.col("at").cast("bigint").alias("source_row"))

    pairs = [(f"{v}_{schemas[3][0]}_{run_date}_disagree_{k}_{x}.csv", schemas[3][0], v, schemas[3][2], 1, 1000 + k, (100.0 + k) * m) for k in range(20) for x, v, m in (("a", VENDORS[0], 1.0), ("b", VENDORS[1], 1.5))]
    two = spark.createDataFrame(pairs, _FILE + ", v double")
    apart = _feed_rows(spark, two.drop("v"), run_date, seed).join(two.select("source_file", "v"), "source_file").withColumn("value1", F.col("v").cast("string"))
    apart_marks = apart.select(F.lit("cross_source_disagreement").alias("check"), "source_file", F.col("at").cast("bigint").alias("source_row"))
    extra = lambda df: df.select(*columns, F.lit(None).cast("string").alias("unexpected_extra_column"))
    return extra(rows).unionByName(odd.select(*columns, "unexpected_extra_column")).unionByName(extra(apart)), marks.unionByName(odd_marks).unionByName(apart_marks)


def daily_corpus(spark: SparkSession, *, files: int = DAILY_FILES, rows: int = DAILY_ROWS, seed: int = 2026) -> DataFrame:
    """Rows of one clean day's files: 35 schemas, ids unique within each file."""
    from ..schemas import DAILY_COLUMNS

    schemas = spark.createDataFrame(daily_schemas(), "schema string, asset_class string, neg boolean, low double, high double")
    cells = schemas.select("*", F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("at"))
    u = lambda what: _unit(seed, F.lit(what), F.col("schema"), F.col("k"), F.col("at"))
    number = F.pmod(F.floor(_unit(seed, F.lit("id"), F.col("schema"), F.col("k")) * 99999) + F.col("at") * 6661, F.lit(99999))
    return cells.select(
        F.format_string("%s_%03d.csv", "schema", "k").alias("source_file"),
        "at",
        F.lit(DAILY_DATE).alias("as_of_date"),
        F.format_string("%s%05d", F.upper(F.substring("asset_class", 1, 3)), number).alias("instrument_id"),
        F.format_string("%.4f", F.greatest(F.col("low") + u("v1") * (F.col("high") - F.col("low")), F.lit(0.5) + F.col("low"))).alias("value1"),
        F.format_string("%.6f", 0.01 + 0.98 * u("v2")).alias("value2"),
        F.lit("USD").alias("currency"),
        F.lit("vendor_a").alias("source_vendor"),
        F.array(*map(F.lit, DAILY_COLUMNS)).alias("header"),
    )
