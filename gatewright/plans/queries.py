"""The registered queries over the star schema, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import business_days, is_blank, iso_date, number
from ..operators import audit, bitemporal, compare, pnl
from ..operators import quarantine as q
from ..sources.domain import domain_table
from ..sources.files import load_vintages
from . import io_queries, sql_text
from .rules import DAILY_DATE, DAILY_RULES, FEED_RULES, GATE_RULES, Rule
from .sql_text import RUN_DATE, for_duckdb

Query = Callable[[SparkSession, str], DataFrame]

GATE_INPUTS = ("security_master", "pricing", "positions", "funds", "fx_rates", "ref_benchmarks", "ref_currency")


class LazyTables(dict):
    """Domain tables of a directory, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir, self._base = spark, sf_dir, {}

    def __missing__(self, name: str) -> DataFrame:
        if name == "instrument_master":
            self[name] = self._spark.read.parquet(f"{self._dir}/customer.parquet").select(F.concat(F.lit("INST-"), "c_custkey").alias("instrument_id"))
        else:
            self[name] = domain_table(self._spark, self._dir, name, self._base)
        return self[name]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _rule_query(rule: Rule) -> Query:
    return lambda spark, sf_dir: q.rule_rows(LazyTables(spark, sf_dir), rule, RUN_DATE)


def _counts(rules: tuple[Rule, ...]) -> Query:
    return lambda spark, sf_dir: q.violations(LazyTables(spark, sf_dir), rules, RUN_DATE, snapshots=False, details=False).groupBy("rule_name").agg(F.count("*").alias("n"))


def _quarantined(rules: tuple[Rule, ...]) -> Query:
    return lambda spark, sf_dir: q.quarantine(LazyTables(spark, sf_dir), rules, "run-1", RUN_DATE)


def _quarantine_rows(rules: tuple[Rule, ...]) -> Query:
    return lambda spark, sf_dir: _quarantined(rules)(spark, sf_dir).select("quarantine_id", "rule_name", "owner_name", "source_file", "source_row", "column_name")


def _replayed(rules: tuple[Rule, ...]) -> Query:
    return lambda spark, sf_dir: audit.replay_totals(audit.replay(audit.audit_entries(_quarantined(rules)(spark, sf_dir)), rules))


def _vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp_ntz").alias("recorded_at"), F.col("event_id").alias("seq"), F.col("value").alias("value"))


def bitemporal_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return bitemporal.as_of(_vintages(spark, sf_dir), at)


def bitemporal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.latest(_vintages(spark, sf_dir))


def vintage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.vintage_counts(_vintages(spark, sf_dir))


def key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.key_count(_vintages(spark, sf_dir))


def loaded_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = load_vintages(LazyTables(spark, sf_dir) | {n: domain_table(spark, sf_dir, n) for n in ("security_master", "pricing", "positions")}, F.to_timestamp(F.lit(RUN_DATE)))
    picked = bitemporal.latest(loaded)
    return picked.select("key", "seq", F.col("payload")["instrument_id"].alias("instrument_id"), F.coalesce(F.col("payload")["price"], F.col("payload")["market_value"], F.col("payload")["cusip"]).alias("held"))


def pnl_tie_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.tie_out(domain_table(spark, sf_dir, "pnl_src"))


def pnl_tie_out_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.tie_out(pnl.densified(domain_table(spark, sf_dir, "pnl_src")))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.floor(F.col("value") * 100).cast("bigint")
    found = compare.nearest_rank(_events(spark, sf_dir).select("event_type", cents.alias("v")), "v", {"p50": 0.50, "p99": 0.99}, ("event_type",))
    return found.select("event_type", "p50", "p99", "largest", F.round("mean", 4).alias("mean"))


def file_row_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = domain_table(spark, sf_dir, "vendor_record").groupBy("schema_name", "source_file").agg(F.count("*").alias("n"))
    return compare.median_of(files.where("n >= 50"), "n", ("schema_name",))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_table(spark, sf_dir, "vendor_records").groupBy("schema", F.col("source_file").alias("file_name")).agg(F.count("*").alias("row_count"))


def lineage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.missing_lineage(q.violations(LazyTables(spark, sf_dir), DAILY_RULES, DAILY_DATE, snapshots=False, details=False))


def unpriced_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, priced = domain_table(spark, sf_dir, "positions").select("instrument_id"), domain_table(spark, sf_dir, "pricing").select("instrument_id")
    return held.exceptAll(priced).groupBy("instrument_id").agg(F.count("*").alias("n"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain_table(spark, sf_dir, "vendor_record")
    return p.select(
        "source_row",
        F.upper(F.substring("instrument_id", 1, 3)).alias("prefix"),
        F.length(F.trim("instrument_id")).alias("trimmed"),
        F.position(F.lit("-"), "instrument_id").alias("dash"),
        is_blank(F.col("as_of_date")).alias("undated"),
        number(F.col("value1"), 0.0).alias("value"),
        F.datediff(F.to_date(F.lit(RUN_DATE)), iso_date(F.col("as_of_date"))).alias("age"),
        F.lpad(F.col("source_row").cast("string"), 8, "0").alias("padded"),
        F.concat_ws("|", "vendor", "schema_name").alias("feed"),
        F.split_part("source_file", F.lit("_"), F.lit(2)).alias("part"),
    )


def business_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.explode(business_days("2026-07-20", "2026-08-28")).alias("day"))


_VINTAGE_SQL = "SELECT concat(cast(user_id as varchar(20)), '|', event_type) AS key, ts AS recorded_at, event_id AS seq, value FROM events"
_PNL_SQL = """, src AS ({src}),
b AS (SELECT fund_id, position_date, sum(d) AS bottom_up FROM (SELECT fund_id, position_date, market_value - lag(market_value) OVER (PARTITION BY fund_id, instrument_id ORDER BY position_date) AS d FROM src) x WHERE d IS NOT NULL GROUP BY fund_id, position_date),
t AS (SELECT fund_id, position_date, d AS top_down FROM (SELECT fund_id, position_date, total - lag(total) OVER (PARTITION BY fund_id ORDER BY position_date) AS d FROM (SELECT fund_id, position_date, sum(market_value) AS total FROM src GROUP BY fund_id, position_date) y) z WHERE d IS NOT NULL)
SELECT coalesce(b.fund_id, t.fund_id) AS fund_id, coalesce(b.position_date, t.position_date) AS position_date, bottom_up, top_down, coalesce(abs(bottom_up - top_down) > 0.01, true) AS mismatch FROM b FULL OUTER JOIN t ON b.fund_id = t.fund_id AND b.position_date = t.position_date"""
_DENSE_SQL = "SELECT g.fund_id, g.instrument_id, d.position_date, coalesce(s.market_value, 0) AS market_value FROM (SELECT DISTINCT fund_id, instrument_id FROM pnl_src) g CROSS JOIN (SELECT DISTINCT position_date FROM pnl_src) d LEFT JOIN pnl_src s ON s.fund_id = g.fund_id AND s.instrument_id = g.instrument_id AND s.position_date = d.position_date"


def _latest_sql(source: str, where: str = "true") -> str:
    return f"SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY recorded_at DESC, seq ASC) AS rk FROM ({source}) v WHERE {where}) r WHERE rk = 1"


def _id_sql(rule_set: str) -> str:
    made_of = "concat_ws(chr(1), 'run-1', rule_name, coalesce(source_file, ''), coalesce(cast(source_row as varchar), ''), coalesce(column_name, ''), coalesce(schema, ''))"
    return for_duckdb(f"SELECT sha256({made_of}) AS quarantine_id, rule_name, owner_name, source_file, source_row, column_name FROM ({sql_text.all_rules_sql(rule_set)}) v")


_SETS: dict[str, tuple[Rule, ...]] = {"gate": GATE_RULES, "feed": FEED_RULES, "daily": DAILY_RULES}


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, rules in _SETS.items():
        found |= {f"{name}_{r.name}": _rule_query(r) for r in rules}
        found[f"{name}_counts"] = _counts(rules)
        found[f"{name}_quarantine"] = _quarantine_rows(rules)
        found[f"{name}_replay"] = _replayed(rules)
    for f in (bitemporal_as_of, bitemporal_latest, vintage_counts, key_count, loaded_vintages, pnl_tie_out, pnl_tie_out_dense, latency_percentiles, file_row_medians, file_manifest, lineage_totals, unpriced_positions, scalar_functions, business_calendar):
        found[f.__name__] = f
    return found | io_queries.queries()


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name, rules in _SETS.items():
        found |= {f"{name}_{r.name}": for_duckdb(sql_text.RULE_SQL[name, r.name]) for r in rules}
        union = sql_text.all_rules_sql(name)
        found[f"{name}_counts"] = for_duckdb(f"SELECT rule_name, count(*) AS n FROM ({union}) v GROUP BY rule_name")
        found[f"{name}_quarantine"] = _id_sql(name)
        found[f"{name}_replay"] = for_duckdb(f"SELECT count(*) AS total, count(*) AS reproduced FROM ({union}) v")
    with_src = lambda src: for_duckdb("SELECT 1").rsplit("\n", 1)[0] + _PNL_SQL.format(src=src)
    loaded = " UNION ALL ".join(
        [
            "SELECT concat('SM|', instrument_id) AS key, source_row AS seq, 1 AS recorded_at, instrument_id, cusip AS held FROM security_master",
            "SELECT concat('PRICE|', instrument_id, '|', cast(price_date as varchar)) AS key, source_row AS seq, 1 AS recorded_at, instrument_id, cast(price as varchar) AS held FROM pricing",
            "SELECT concat('POS|', fund_id, '|', instrument_id, '|', cast(position_date as varchar)) AS key, source_row AS seq, 1 AS recorded_at, instrument_id, cast(market_value as varchar) AS held FROM positions",
        ]
    )
    return found | io_queries.oracle_sql() | {
        "bitemporal_as_of": _latest_sql(_VINTAGE_SQL, "recorded_at <= timestamp '2024-01-15 00:00:00'"),
        "bitemporal_latest": _latest_sql(_VINTAGE_SQL),
        "vintage_counts": f"SELECT key, count(*) AS vintages FROM ({_VINTAGE_SQL}) v GROUP BY key",
        "key_count": f"SELECT count(DISTINCT key) AS keys FROM ({_VINTAGE_SQL}) v",
        "loaded_vintages": for_duckdb(f"SELECT key, seq, instrument_id, held FROM ({_latest_sql(loaded)}) x"),
        "pnl_tie_out": with_src("SELECT * FROM pnl_src"),
        "pnl_tie_out_dense": with_src(_DENSE_SQL),
        "latency_percentiles": "WITH e AS (SELECT event_type, cast(floor(value * 100) as bigint) AS v FROM events WHERE value IS NOT NULL), r AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e) SELECT event_type, max(CASE WHEN k = floor(n * 0.5) THEN v END) AS p50, max(CASE WHEN k = floor(n * 0.99) THEN v END) AS p99, max(v) AS largest, round(avg(v), 4) AS mean FROM r GROUP BY event_type",
        "file_row_medians": for_duckdb("SELECT schema_name, median(n) AS median FROM (SELECT schema_name, source_file, count(*) AS n FROM vendor_record GROUP BY schema_name, source_file) f WHERE n >= 50 GROUP BY schema_name"),
        "file_manifest": for_duckdb("SELECT schema, source_file AS file_name, count(*) AS row_count FROM vendor_records GROUP BY schema, source_file"),
        "lineage_totals": for_duckdb(f"SELECT count(*) AS violations, count(*) FILTER (WHERE coalesce(source_file, '') = '' OR source_row IS NULL) AS missing_lineage FROM ({sql_text.all_rules_sql('daily')}) v"),
        "unpriced_positions": for_duckdb("SELECT instrument_id, count(*) AS n FROM (SELECT instrument_id FROM positions EXCEPT ALL SELECT instrument_id FROM pricing) x GROUP BY instrument_id"),
        "scalar_functions": for_duckdb(
            f"SELECT source_row, upper(substr(instrument_id, 1, 3)) AS prefix, length(trim(instrument_id)) AS trimmed, position('-' in instrument_id) AS dash, trim(as_of_date) = '' AS undated, coalesce(try_cast(value1 as double), 0.0) AS value, datediff('day', try_cast(as_of_date as date), date '{RUN_DATE}') AS age, lpad(cast(source_row as varchar), 8, '0') AS padded, concat_ws('|', vendor, schema_name) AS feed, split_part(source_file, '_', 2) AS part FROM vendor_record"
        ),
        "business_calendar": "SELECT cast(d as date) AS day FROM generate_series(date '2026-07-20', date '2026-08-28', interval 1 day) t(d) WHERE dayofweek(d) BETWEEN 1 AND 5",
    }
