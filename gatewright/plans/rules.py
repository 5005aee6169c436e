"""The rule registry: 22 gate rules, 14 feed checks and 30 daily rules.

A rule is a pure predicate over named fields. Detection evaluates it over an enriched table,
replay over the snapshot that was stored with the decision: the same function is called with
another way to reach the fields.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import is_blank, is_distinct, is_missing, is_trimmed_empty, is_whole, iso_date


class Fields:
    """Typed columns of an enriched table."""

    def text(self, name: str) -> Column:
        return F.col(name).cast("string")

    def number(self, name: str) -> Column:
        return F.col(name)

    def exact(self, name: str) -> Column:
        return F.col(name)

    def day(self, name: str) -> Column:
        return F.col(name)

    def count(self, name: str) -> Column:
        return F.col(name)

    def flag(self, name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))


class SnapshotFields(Fields):
    """Fields of a stored snapshot, a map of texts; a text that is no value of the type is null."""

    def __init__(self, column: str = "snapshot"):
        self._map = F.col(column)

    def text(self, name: str) -> Column:
        return F.try_element_at(self._map, F.lit(name))

    def number(self, name: str) -> Column:
        return self.text(name).try_cast("double")

    def exact(self, name: str) -> Column:
        return self.text(name).try_cast("decimal(30,6)")

    def day(self, name: str) -> Column:
        return iso_date(self.text(name))

    def count(self, name: str) -> Column:
        return self.text(name).try_cast("bigint")

    def flag(self, name: str) -> Column:
        return F.coalesce(self.text(name) == "true", F.lit(False))


@dataclass(frozen=True)
class Rule:
    """``needs`` are the context fields that the predicate reads beside the row's own."""

    name: str
    category: str
    anchor: str
    column: str | None
    predicate: Callable[[Fields], Column]
    detail: Callable[[Fields], Column]
    needs: tuple[str, ...] = ()
    level: str = "row"


def _say(*parts) -> Callable[[Fields], Column]:
    """A detail text; ``{name}`` parts are fields. Null if any field is null."""
    return lambda f: F.concat(*[f.text(p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts])


def _twice_beyond(value: Column, reference: Column, per_mille: int) -> Column:
    """|value - reference| over |reference| is more than per_mille / 1000, without dividing."""
    return F.abs(value - reference) * 1000 > F.abs(reference) * per_mille


GATE_RULES: tuple[Rule, ...] = (
    Rule("stale_price", "pricing", "pricing", "price_date", lambda f: (f.day("price_date") == f.day("_latest_date")) & (f.day("price_date") < F.date_sub(f.day("_dataset_max_date"), 5)), _say("latest price for ", "{instrument_id}", " is ", "{_latest_date}", ", more than 5 days older than dataset max ", "{_dataset_max_date}"), ("_latest_date", "_dataset_max_date")),
    Rule("missing_price", "pricing", "security_master", "instrument_id", lambda f: ~f.flag("_has_any_price"), _say("{instrument_id}", " has no pricing rows in the dataset"), ("_has_any_price",)),
    Rule("future_dated_price", "pricing", "pricing", "price_date", lambda f: f.day("price_date") > f.day("_as_of_today"), _say("price_date ", "{price_date}", " is after the validation run date"), ("_as_of_today",)),
    Rule("negative_price", "pricing", "pricing", "price", lambda f: f.exact("price") < 0, _say("price ", "{price}", " is negative")),
    Rule("zero_price", "pricing", "pricing", "price", lambda f: f.exact("price") == 0, _say("price is exactly zero")),
    Rule("price_band_breach", "pricing", "pricing", "price", lambda f: (f.exact("price") > 0) & _twice_beyond(f.exact("price"), f.exact("_prev_price"), 500), _say("price ", "{price}", " moved more than 50% from prior session price ", "{_prev_price}"), ("_prev_price",)),
    Rule("price_currency_mismatch", "pricing", "pricing", "currency", lambda f: f.flag("_instrument_exists") & is_distinct(f.text("currency"), f.text("_security_master_currency")), _say("pricing currency ", "{currency}", " does not match security master currency ", "{_security_master_currency}"), ("_instrument_exists", "_security_master_currency")),
    Rule("missing_benchmark", "security_master", "security_master", "benchmark_id", lambda f: f.text("asset_class").isin("Equity", "ETF") & (is_missing(f.text("benchmark_id")) | ~f.flag("_benchmark_resolves")), _say("{asset_class}", " instrument ", "{instrument_id}", " has no resolvable benchmark_id"), ("_benchmark_resolves",)),
    Rule("duplicate_identifier", "security_master", "security_master", "cusip", lambda f: ~is_missing(f.text("cusip")) & (f.count("_cusip_count") > 1), _say("cusip ", "{cusip}", " is shared by more than one instrument"), ("_cusip_count",)),
    Rule("missing_asset_class", "security_master", "security_master", "asset_class", lambda f: is_missing(f.text("asset_class")), _say("instrument ", "{instrument_id}", " has no asset_class")),
    Rule("missing_currency_code", "security_master", "security_master", "currency", lambda f: is_missing(f.text("currency")), _say("instrument ", "{instrument_id}", " has no currency code")),
    Rule("invalid_currency_code", "security_master", "security_master", "currency", lambda f: ~is_missing(f.text("currency")) & ~f.flag("_currency_is_valid_iso"), _say("currency code ", "{currency}", " is not a recognized ISO code"), ("_currency_is_valid_iso",)),
    Rule("missing_sector_for_equity", "security_master", "security_master", "sector", lambda f: (f.text("asset_class") == "Equity") & is_missing(f.text("sector")), _say("equity instrument ", "{instrument_id}", " has no sector")),
    Rule("missing_maturity_date_for_bond", "security_master", "security_master", "maturity_date", lambda f: (f.text("asset_class") == "Bond") & is_missing(f.text("maturity_date")), _say("bond ", "{instrument_id}", " has no maturity_date")),
    Rule("coupon_rate_out_of_range_for_bond", "security_master", "security_master", "coupon_rate", lambda f: (f.text("asset_class") == "Bond") & ((f.exact("coupon_rate") < 0) | (f.exact("coupon_rate") > F.lit("0.20").cast("decimal(4,2)"))), _say("bond ", "{instrument_id}", " coupon_rate ", "{coupon_rate}", " is out of the 0-20% range")),
    Rule("holdings_to_nav_tie_out", "position_fund", "funds", "reported_nav", lambda f: f.exact("reported_nav").isNull() | (f.exact("reported_nav") == 0) | _twice_beyond(f.exact("_true_total"), f.exact("reported_nav"), 5), _say("fund ", "{fund_id}", " on ", "{nav_date}", " reported_nav ", "{reported_nav}", " vs true holdings total ", "{_true_total}"), ("_true_total",)),
    Rule("orphan_position", "position_fund", "positions", "instrument_id", lambda f: ~f.flag("_instrument_exists"), _say("position references instrument_id ", "{instrument_id}", " not present in security master"), ("_instrument_exists",)),
    Rule("negative_position_quantity", "position_fund", "positions", "quantity", lambda f: (f.exact("quantity") < 0) & (F.coalesce(f.text("_security_master_asset_class"), F.lit("")) != "Cash"), _say("position in ", "{instrument_id}", " has negative quantity ", "{quantity}"), ("_security_master_asset_class",)),
    Rule("duplicate_position_row", "position_fund", "positions", "position_date", lambda f: f.count("_key_count") > 1, _say("(", "{fund_id}", ", ", "{instrument_id}", ", ", "{position_date}", ") appears more than once"), ("_key_count",)),
    Rule("matured_bond_still_priced", "position_fund", "pricing", "price_date", lambda f: f.day("price_date") > f.day("_maturity_date"), _say("bond ", "{instrument_id}", " priced on ", "{price_date}", " after its maturity_date ", "{_maturity_date}"), ("_maturity_date",)),
    Rule("fx_rate_missing_for_nonbase_currency", "position_fund", "positions", "local_currency", lambda f: ~is_missing(f.text("local_currency")) & (f.text("local_currency") != "USD") & ~f.flag("_fx_rate_exists"), _say("no fx rate found for ", "{local_currency}", " on ", "{position_date}"), ("_fx_rate_exists",)),
    Rule("position_date_mismatch", "position_fund", "positions", "position_date", lambda f: ~f.flag("_price_exists_for_date"), _say("no pricing row for instrument ", "{instrument_id}", " on position_date ", "{position_date}"), ("_price_exists_for_date",)),
)


def _feed(name: str, column: str | None, predicate: Callable[[Fields], Column], detail: str, *needs: str) -> Rule:
    return Rule(name, "feed_health", "vendor_record", column, predicate, _say(detail), needs)


#: Accepted currencies of the feeds, and their bounds in days and shares: fixed values.
FEED_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF")
STALE_DAYS, LATE_DAYS = 5, 6
DISAGREEMENT_PER_MILLE, ROW_COUNT_SHARE, BASELINE_ROWS = 150, 0.30, 50


def _age(f: Fields) -> Column:
    """Days from the record's date to the run date; null if the record's is no date."""
    return F.datediff(f.day("_run_date"), iso_date(f.text("as_of_date")))


def _value(f: Fields) -> Column:
    return f.text("value1").try_cast("double")


FEED_RULES: tuple[Rule, ...] = (
    _feed("schema_drift_column_count", None, lambda f: f.count("actual_column_count") != f.count("declared_column_count"), "the file's column count differs from the declared one"),
    _feed("schema_drift_missing_column", None, lambda f: f.flag("missing_required_column"), "the file lacks a required column"),
    _feed("missing_required_field", "instrument_id", lambda f: is_blank(f.text("instrument_id")) | is_blank(f.text("as_of_date")), "instrument_id or as_of_date is blank"),
    _feed("cross_source_disagreement", "value1", lambda f: (f.text("_first_vendor") != f.text("_last_vendor")) & (f.number("_value_max") > 0) & ((f.number("_value_max") - f.number("_value_min")) / f.number("_value_max") > DISAGREEMENT_PER_MILLE / 1000), "vendors disagree by more than 15%", "_first_vendor", "_last_vendor", "_value_max", "_value_min"),
    _feed("duplicate_row", "instrument_id", lambda f: f.count("_row_key_count") > 1, "the vendor delivers this record more than once", "_row_key_count"),
    _feed("orphan_instrument_reference", "instrument_id", lambda f: ~is_blank(f.text("instrument_id")) & ~f.flag("_instrument_known"), "instrument_id is not in the master", "_instrument_known"),
    _feed("invalid_currency_code", "currency", lambda f: ~is_blank(f.text("currency")) & ~f.text("currency").isin(*FEED_CURRENCIES), "currency is not an accepted code"),
    _feed("future_dated_record", "as_of_date", lambda f: _age(f) < 0, "as_of_date is after the run date", "_run_date"),
    _feed("stale_feed", "as_of_date", lambda f: _age(f) > STALE_DAYS, "as_of_date is more than 5 days before the run date", "_run_date"),
    _feed("late_arriving_record", "as_of_date", lambda f: _age(f) > LATE_DAYS, "as_of_date is more than 6 days before the run date", "_run_date"),
    _feed("type_mismatch", "value1", lambda f: ~is_blank(f.text("value1")) & _value(f).isNull(), "value1 is not a number"),
    _feed("negative_value", "value1", lambda f: (_value(f) < 0) & ~f.flag("_allow_negative_value1") & f.number("_value1_upper_bound").isNotNull(), "value1 is negative where the schema forbids it", "_allow_negative_value1", "_value1_upper_bound"),
    _feed("value_out_of_range", "value1", lambda f: F.abs(_value(f)) > f.number("_value1_upper_bound"), "value1 is beyond the schema's bound", "_value1_upper_bound"),
    _feed("row_count_anomaly", None, lambda f: F.abs(f.count("_file_rows") - f.number("_median_rows")) / f.number("_median_rows") > ROW_COUNT_SHARE, "the file's row count is more than 30% off the schema's median", "_file_rows", "_median_rows"),
)


#: Reference date, rows per file and files per schema of the daily flow: fixed values.
DAILY_DATE, DAILY_ROWS, DAILY_FILES = "2026-10-05", 15, 44


def _daily(name: str, column: str | None, predicate: Callable[[Fields], Column], detail: str, *needs: str, anchor: str = "vendor_records", level: str = "row") -> Rule:
    return Rule(name, "daily", anchor, column, predicate, _say(detail), needs, level)


DAILY_RULES: tuple[Rule, ...] = (
    _daily("missing_instrument_id", "instrument_id", lambda f: is_trimmed_empty(f.text("instrument_id")), "instrument_id is missing"),
    _daily("missing_currency", "currency", lambda f: is_trimmed_empty(f.text("currency")), "currency is missing"),
    _daily("missing_as_of_date", "as_of_date", lambda f: is_trimmed_empty(f.text("as_of_date")), "as_of_date is missing"),
    _daily("missing_value1", "value1", lambda f: f.number("value1").isNull(), "value1 is missing"),
    _daily("missing_value2", "value2", lambda f: f.number("value2").isNull(), "value2 is missing"),
    _daily("missing_source_vendor", "source_vendor", lambda f: is_trimmed_empty(f.text("source_vendor")), "source_vendor is missing"),
    _daily("value1_below_schema_min", "value1", lambda f: f.number("value1") < f.number("value1_min"), "value1 is below the schema's least value"),
    _daily("value1_above_schema_max", "value1", lambda f: f.number("value1") > f.number("value1_max"), "value1 is above the schema's largest value"),
    _daily("value1_negative_when_disallowed", "value1", lambda f: (f.number("value1") < 0) & ~f.flag("allow_negative_value1"), "value1 is negative where the schema forbids it"),
    _daily("value1_gross_outlier_10x_max", "value1", lambda f: f.number("value1") > f.number("value1_max") * 10, "value1 is above ten times the schema's largest value"),
    _daily("value2_below_zero", "value2", lambda f: f.number("value2") < 0, "value2 is below 0"),
    _daily("value2_above_one", "value2", lambda f: f.number("value2") > 1, "value2 is above 1"),
    _daily("non_usd_currency", "currency", lambda f: f.text("currency") != "USD", "currency is not USD"),
    _daily("unknown_source_vendor", "source_vendor", lambda f: ~f.text("source_vendor").isin("vendor_a", "vendor_b", "vendor_c"), "source_vendor is unknown"),
    _daily("stale_as_of_date_past", "as_of_date", lambda f: f.text("as_of_date") < DAILY_DATE, "as_of_date is before the reference date"),
    _daily("future_dated_record", "as_of_date", lambda f: f.text("as_of_date") > DAILY_DATE, "as_of_date is after the reference date"),
    _daily("instrument_id_wrong_prefix", "instrument_id", lambda f: F.upper(F.substring(f.text("instrument_id"), 1, 3)) != F.upper(F.substring(f.text("asset_class"), 1, 3)), "instrument_id does not start as its asset class"),
    _daily("duplicate_instrument_within_file", "instrument_id", lambda f: f.text("instrument_id").isNotNull() & (f.count("_first_row") != f.count("_last_row")), "instrument_id occurs in another row of the file", "_first_row", "_last_row"),
    _daily("source_row_negative", "source_row", lambda f: f.count("source_row") < 0, "source_row is negative"),
    _daily("source_file_blank", "source_file", lambda f: is_trimmed_empty(f.text("source_file")), "source_file is missing"),
    _daily("schema_label_mismatch", "source_file", lambda f: F.position(f.text("schema"), f.text("source_file")) != 1, "source_file does not start with the schema's name"),
    _daily("currency_not_three_letters", "currency", lambda f: F.length(f.text("currency")) != 3, "currency has not three characters"),
    _daily("instrument_id_wrong_length", "instrument_id", lambda f: F.length(f.text("instrument_id")) != 8, "instrument_id has not eight characters"),
    _daily("value1_exactly_zero", "value1", lambda f: f.number("value1") == 0, "value1 is zero"),
    _daily("as_of_date_wrong_format", "as_of_date", lambda f: ~f.text("as_of_date").rlike(r"^\d{4}-\d{2}-\d{2}\z"), "as_of_date has not the form yyyy-mm-dd"),
    _daily("value2_is_integer_valued", "value2", lambda f: is_whole(f.number("value2")) & (f.number("value2") > 0), "value2 is a whole number"),
    _daily("empty_file", None, lambda f: f.count("row_count") == 0, "the file has no rows", anchor="file_manifest", level="file"),
    _daily("row_count_anomaly_low", None, lambda f: (f.count("row_count") < DAILY_ROWS) & (f.count("row_count") > 0), "the file has too few rows", anchor="file_manifest", level="file"),
    _daily("row_count_anomaly_high", None, lambda f: f.count("row_count") > DAILY_ROWS, "the file has too many rows", anchor="file_manifest", level="file"),
    _daily("file_count_below_expected", None, lambda f: f.count("file_count") < DAILY_FILES, "the schema has too few files", anchor="schema_counts", level="schema"),
)

RULE_SETS: dict[str, tuple[Rule, ...]] = {"gate": GATE_RULES, "feed": FEED_RULES, "daily": DAILY_RULES}
