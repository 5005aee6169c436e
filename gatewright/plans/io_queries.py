"""Registered queries of sources, sinks, vintages, scoring and streams, each with its SQL.

Each writes what its source reads to the shared folder, from the domain tables, and gives what
comes back; the SQL says the same of the domain tables directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import row_json
from ..operators import audit, bitemporal
from ..operators import quarantine as q
from ..schemas import FEED_COLUMNS, VINTAGE
from ..sources import corpus, files, sinks
from ..sources.domain import domain_table
from ..sources.staging import fresh_path, stage
from ..streaming import changefeed
from .rules import DAILY_DATE, DAILY_RULES, GATE_RULES
from .sql_text import RULE_SQL, RUN_DATE, all_rules_sql, for_duckdb

Query = Callable[[SparkSession, str], DataFrame]


def _named(rules, *names: str) -> list:
    return [r for r in rules if r.name in names]


def _vendor_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_table(spark, sf_dir, "vendor_record")


def source_vendor_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two layouts in one folder: columns turned round, and one absent with an unknown one in place."""
    path = fresh_path(spark, "feeds")
    # By ranges, as a file of a first partition without rows would be a header alone, which a strict reader refuses.
    rows = _vendor_record(spark, sf_dir)
    whole = rows.select("source_row", *[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in FEED_COLUMNS])
    half = lambda k: whole.where(f"source_row % 2 = {k}").repartitionByRange("source_row")
    plain = half(0).select(*FEED_COLUMNS[::-1])
    drifted = half(1).select(*[F.lit("x").alias("note") if c == "currency" else c for c in FEED_COLUMNS])
    for part in (plain, drifted):
        part.write.mode("append").option("header", True).option("emptyValue", "").csv(path)
    read = files.read_vendor_feeds(spark, path)
    return read.select("vendor", "schema_name", "instrument_id", "as_of_date", "currency", "value1", "actual_column_count", "missing_required_column")


def source_gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "corpus")
    domain_table(spark, sf_dir, "positions").write.option("header", True).csv(f"{root}/positions.csv")
    return files.read_gate_table(spark, root, "positions").select("fund_id", "instrument_id", "position_date", "quantity", "market_value", "local_currency", "source_row")


def source_typed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, '' for null, as the daily files hold them, with the attributes of their schemas."""
    records = domain_table(spark, sf_dir, "vendor_records")
    attributes = ("asset_class", "allow_negative_value1", "value1_min", "value1_max")
    schemas = records.select("schema", *attributes).distinct()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    landed = records.drop(*attributes).withColumns({"value1": text("value1"), "value2": text("value2")})
    typed = files.typed_daily_records(landed, schemas)
    return typed.select("instrument_id", "value1", "value2", "schema", "source_file", "source_row", "asset_class", "allow_negative_value1", "value1_max")


def source_defect_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "manifest")
    row = F.col("source_row")
    anchors = F.concat(F.lit("positions.csv|"), row.cast("string"), F.lit(";positions.csv|"), (row + 1).cast("string"))
    named = domain_table(spark, sf_dir, "positions").where("quantity < 0").select(F.concat(F.lit("negative_position_quantity\t"), anchors).alias("line"))
    named.write.text(path)
    each = files.read_defect_manifest(spark, path).select("rule_name", F.explode("anchors").alias("a"))
    return each.select("rule_name", "a.source_file", "a.source_row")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest over positions, of which every fifth defect has an anchor that nothing finds, and what is found."""
    tables = {n: domain_table(spark, sf_dir, n) for n in ("positions", "security_master")}
    found = q.violations(tables, _named(GATE_RULES, "negative_position_quantity"), RUN_DATE, snapshots=False, details=False)
    at = lambda row: F.struct(F.lit("positions.csv").alias("source_file"), row.cast("bigint").alias("source_row"))
    row = F.col("source_row")
    anchors = F.when(row % 5 == 0, F.array(at(row), at(-row))).otherwise(F.array(at(row)))
    manifest = tables["positions"].where("quantity < 0 AND source_row % 3 <> 0").select(row.cast("bigint").alias("defect_id"), F.lit("negative_position_quantity").alias("rule_name"), anchors.alias("anchors"))
    return manifest, found


def manifest_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.score(*_scored(spark, sf_dir))


def manifest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recall(audit.score(*_scored(spark, sf_dir)))


def manifest_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.false_positives(*_scored(spark, sf_dir))


def companion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = domain_table(spark, sf_dir, "pricing").select("source_file", "source_row", "instrument_id", "currency")
    return audit.with_companion(records, ["instrument_id"]).select("source_row", "instrument_id", "companion_instrument_id")


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the daily flow extracts, finds and reconciles."""
    tables = {n: stage(domain_table(spark, sf_dir, n), n) for n in ("vendor_records", "file_manifest")}
    found = q.missing_lineage(q.violations(tables, DAILY_RULES, DAILY_DATE, snapshots=False, details=False))
    counts = tables["file_manifest"].agg(F.sum("row_count").alias("record_count"), F.count("*").alias("file_count"))
    stored = tables["vendor_records"].agg(F.count("*").alias("stored_count"))
    return counts.crossJoin(stored).crossJoin(found)  # one row each


def extract_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts of each schema on its own, put together again."""
    records = stage(domain_table(spark, sf_dir, "vendor_records"), "vendor_records")
    parts = [records.where(F.col("schema") == s) for s in ("equity_us", "bond_us", "etf_us", "swap_us", "option_us")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("schema").agg(F.count("*").alias("records"), F.countDistinct("source_file").alias("files"))


def rows_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _vendor_record(spark, sf_dir)
    return records.select("source_row", row_json("vendor", "schema_name", "declared_column_count").alias("row"))


def snapshots_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row snapshots stored as JSON and read back."""
    prices = domain_table(spark, sf_dir, "pricing")
    back = F.from_json(F.to_json(q.snapshot_of(prices)), "map<string,string>")
    return prices.select("source_row", back["currency"].alias("currency"), back["instrument_id"].alias("instrument_id"), F.size(back).alias("fields"))


def absent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _vendor_record(spark, sf_dir)
    had = F.array("vendor", "schema_name", "currency")
    lacking = F.array_except(F.array(F.lit("VENDOR_1"), F.lit("S1"), F.lit("USD")), had)
    return records.select("source_row", F.array_join(lacking, ",").alias("lacking"), (F.size(lacking) == 0).alias("contains_all"))


_CSV_RULES = ("negative_price", "zero_price")


def _price_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.quarantine({"pricing": domain_table(spark, sf_dir, "pricing")}, _named(GATE_RULES, *_CSV_RULES), "run-1", RUN_DATE)


def quarantine_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "quarantine")
    sinks.write_quarantine_csv(_price_quarantine(spark, sf_dir), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    held = F.from_json("snapshot", "map<string,string>")["instrument_id"]
    return back.select("rule_name", "owner_name", F.col("source_row").cast("bigint").alias("source_row"), "detail", held.alias("instrument_id"))


def audit_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run logged twice counts once; another run beside it stays."""
    path, entries = fresh_path(spark, "audit"), audit.audit_entries(_price_quarantine(spark, sf_dir))
    for run in ("run-2", "run-1", "run-1"):
        audit.append_audit(entries.withColumn("run_id", F.lit(run)), path)
    replayed = audit.replay(audit.read_audit(spark, path), _named(GATE_RULES, *_CSV_RULES))
    return replayed.groupBy("run_id", "rule_name").agg(F.count("*").alias("entries"), F.count_if("reproduced").alias("reproduced"))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, the first retried after the second; the second restates the even vendors' files."""
    path, records = fresh_path(spark, "vintages"), _vendor_record(spark, sf_dir)
    records = records.withColumns({c: F.lit(None).cast("string") for c in ("received_at", "value2", "status", "region")})
    came = lambda day: F.to_timestamp(F.lit(f"2026-10-0{day} 06:00:00"))
    sinks.append_vintage(records, path, "d9", came(5))
    sinks.append_vintage(records.where("vendor IN ('VENDOR_0', 'VENDOR_2', 'VENDOR_4')"), path, "d10", came(6))
    sinks.append_vintage(records, path, "d9", came(5))
    return files.read_vintages(spark, path)


def vintage_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deliveries(spark, sf_dir).groupBy("delivery_id", "schema_name").agg(F.count("*").alias("records"))


def vintage_latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = files.latest_vintages(_deliveries(spark, sf_dir))
    return last.groupBy("source_file", "delivery_id").agg(F.count("*").alias("records"))


def json_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published payload, retried, and read back."""
    path = fresh_path(spark, "published")
    counts = domain_table(spark, sf_dir, "vendor_records").agg(F.count("*").cast("string").alias("n"))
    payload = counts.select(F.create_map(F.lit("as_of_date"), F.lit(DAILY_DATE), F.lit("record_count"), F.col("n")).alias("payload"))
    for delivery in ("r1", "r2", "r1"):
        sinks.append_json_vintage(payload, path, "daily_consolidated", DAILY_DATE, delivery)
    back = files.read_json_vintages(spark, path)
    return back.select("schema", "as_of_date", "delivery_id", F.col("payload")["record_count"].cast("bigint").alias("record_count"))


def staged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table loaded twice, as a view that SQL names."""
    path = fresh_path(spark, "staged")
    for _ in range(2):
        files.reload_table(domain_table(spark, sf_dir, "security_master"), path)
    files.register_views({"security_master": spark.read.parquet(path)}, prefix="staged_")
    return spark.sql("SELECT currency, count(*) AS n FROM staged_security_master GROUP BY currency")


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and numbering of the clean gate corpus of 30 days."""
    tables, _ = corpus.gate_corpus(spark, days=30)
    parts = [tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row")) for n in ("pricing", "positions", "funds")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def corpus_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded defects of the gate corpus by rule, how many are caught, and rows found by each rule."""
    tables, manifest = corpus.gate_corpus(spark, days=30, defects=True)
    found = stage(q.violations(tables, GATE_RULES, "2026-08-28", snapshots=False, details=False), "found")
    caught = audit.score(manifest, found).groupBy("rule_name").agg(F.count("*").alias("defects"), F.count_if("caught").alias("caught"))
    return caught.join(q.counts_by_rule(found), "rule_name")


def _price_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = domain_table(spark, sf_dir, "pricing")
    none = prices.limit(0)
    held = {"security_master": none.select("instrument_id", "source_row"), "pricing": prices, "positions": none.selectExpr("instrument_id fund_id", "instrument_id", "price_date position_date", "source_row")}
    return files.load_vintages(held, F.to_timestamp(F.lit(RUN_DATE)))


def restated_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative prices restated as positive ones a day later; the latest of each key."""
    v = _price_vintages(spark, sf_dir)
    price = F.col("payload")["price"].cast("decimal(18,2)")
    without = F.map_filter("payload", lambda k, _: k != "price")
    fixed = F.map_concat(without, F.create_map(F.lit("price"), (-price).cast("string")))
    new = bitemporal.latest(v).where(price < 0).select("key", (F.col("recorded_at") + F.expr("interval 1 day")).alias("recorded_at"), "seq", fixed.alias("payload"))
    last = bitemporal.latest(bitemporal.restate(v, new))
    return last.select("key", "seq", F.col("payload")["price"].cast("decimal(18,2)").alias("price"), F.col("payload")["currency"].alias("currency"))


def cached_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads through the cache: all are cached, then moved; only what is invalidated is seen to move."""
    v = stage(_price_vintages(spark, sf_dir).where("seq % 50 = 2"), "vintages")
    cache = bitemporal.LatestCache(fresh_path(spark, "cache"), ttl_seconds=3600)
    keys = v.select("key").distinct()
    cache.read(v, keys).count()
    moved = bitemporal.restate(v, v.select("key", (F.col("recorded_at") + F.expr("interval 1 day")).alias("recorded_at"), (-F.col("seq")).alias("seq"), "payload"))
    cache.invalidate(v.where("seq % 100 = 2").select("key"))
    return cache.read(moved, keys).select("key", "seq")


def price_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest vintage of one key, and none of an unknown one."""
    v = _price_vintages(spark, sf_dir)
    first = domain_table(spark, sf_dir, "pricing").where("source_row = 10").collect()
    keys = [("PRICE", r["instrument_id"], str(r["price_date"])) for r in first] + [("PRICE", "nobody", "2024-01-01")]
    out = spark.createDataFrame([], VINTAGE)
    for key in keys:
        out = out.unionByName(bitemporal.latest_of(v, *key))
    return out.select("key", F.col("payload")["price"].cast("decimal(18,2)").alias("price"))


def _feed_path(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "feed")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("|", F.lit("PRICE"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("recorded_at"))
    changefeed.publish(changefeed.change_events(events), path)
    return path


def _consumed(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives when it has read all there is; a batch that is run again replaces its own output."""
    out = fresh_path(spark, name)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", fresh_path(spark, "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def feed_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = changefeed.read_feed(spark, _feed_path(spark, sf_dir))
    got = _consumed(spark, feed.select("key", "changed_at"), "consumed").select("key", "changed_at")
    message = changefeed.parse_message(changefeed.as_message(F.col("key"), F.col("changed_at")))
    return got.select(message.alias("m")).groupBy("m.key").agg(F.count("*").alias("changes"), F.max("m.changed_at").alias("last_changed_at"))


def feed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by day of event time; in complete mode every batch gives all windows, the last one counts."""
    feed = changefeed.read_feed(spark, _feed_path(spark, sf_dir))
    got = _consumed(spark, changefeed.windowed_changes(feed, "1 day", "3650 days"), "windows", "complete")
    last = got.agg(F.max("batch").alias("last"))
    return got.join(last, F.col("batch") == F.col("last")).select(F.unix_millis(F.col("window")["start"]).alias("window_start"), "changes")


def polling_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    late = events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("changed_at"), (F.col("event_id") % 5).alias("latency_ms"))
    found = changefeed.against_polling(late, interval_ms=200, phase_ms=37)
    return found.select("samples", F.round("push_ms", 4).alias("push_ms"), F.round("poll_ms", 4).alias("poll_ms"))


_ALL = (
    source_vendor_feeds,
    source_gate_table,
    source_typed_daily,
    source_defect_manifest,
    manifest_scoring,
    manifest_recall,
    manifest_false_positives,
    companion_rows,
    daily_totals,
    extract_totals,
    rows_as_json,
    snapshots_from_json,
    absent_columns,
    quarantine_csv,
    audit_retry,
    vintage_deliveries,
    vintage_latest_files,
    json_vintages,
    staged_view,
    corpus_counts,
    corpus_defects,
    restated_vintages,
    cached_reads,
    price_reads,
    feed_consumed,
    feed_windows,
    polling_comparison,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


#: Rows that each rule finds in the corpus of 30 days with 45 seeded defects: fixed values.
_FOUND = {
    **{r.name: 2 for r in GATE_RULES},
    "stale_price": 476,
    "price_band_breach": 4,
    "price_currency_mismatch": 122,
    "duplicate_identifier": 6,
    "duplicate_position_row": 4,
    "matured_bond_still_priced": 60,
    "position_date_mismatch": 374,
}
_MANIFEST = "SELECT source_row AS defect_id, 'negative_position_quantity' AS rule_name, source_row % 5 <> 0 AND found AS caught FROM (SELECT p.source_row, coalesce(s.asset_class, '') <> 'Cash' AS found FROM positions p LEFT JOIN security_master s ON s.instrument_id = p.instrument_id WHERE p.quantity < 0 AND p.source_row % 3 <> 0) x"
_PRICE_KEY = "concat('PRICE|', instrument_id, '|', cast(price_date as varchar))"
_LAST_PRICES = f"SELECT * FROM (SELECT {_PRICE_KEY} AS key, source_row AS seq, price, currency, row_number() OVER (PARTITION BY {_PRICE_KEY} ORDER BY source_row) AS rk FROM pricing) r WHERE rk = 1"


def oracle_sql() -> dict[str, str]:
    price_rules = " UNION ALL ".join(RULE_SQL["gate", n] for n in _CSV_RULES)
    defects = ", ".join(f"('{r.name}', {3 if r.name == 'duplicate_identifier' else 2}, {_FOUND[r.name]})" for r in GATE_RULES)
    domain = {
        "source_vendor_feeds": "SELECT vendor, schema_name, instrument_id, as_of_date, CASE WHEN source_row % 2 = 0 THEN currency ELSE '' END AS currency, value1, 10 AS actual_column_count, false AS missing_required_column FROM vendor_record",
        "source_gate_table": "SELECT fund_id, instrument_id, position_date, cast(quantity as decimal(20,6)) AS quantity, cast(market_value as decimal(20,6)) AS market_value, local_currency, cast(source_row as integer) AS source_row FROM positions",
        "source_typed_daily": "SELECT instrument_id, value1, value2, schema, source_file, source_row, asset_class, allow_negative_value1, value1_max FROM vendor_records",
        "source_defect_manifest": "SELECT 'negative_position_quantity' AS rule_name, 'positions.csv' AS source_file, source_row + unnest([0, 1]) AS source_row FROM positions WHERE quantity < 0",
        "manifest_scoring": f"SELECT defect_id, rule_name, caught FROM ({_MANIFEST}) m",
        "manifest_recall": f"SELECT count(*) AS defects, count(*) FILTER (WHERE caught) AS caught FROM ({_MANIFEST}) m",
        "manifest_false_positives": f"SELECT rule_name, source_file, source_row FROM ({RULE_SQL['gate', 'negative_position_quantity']}) v WHERE source_row % 3 = 0",
        "companion_rows": "SELECT p.source_row, p.instrument_id, c.instrument_id AS companion_instrument_id FROM pricing p LEFT JOIN pricing c ON c.source_row = p.source_row - 1",
        "daily_totals": f"SELECT (SELECT cast(sum(row_count) as bigint) FROM file_manifest) AS record_count, (SELECT count(*) FROM file_manifest) AS file_count, (SELECT count(*) FROM vendor_records) AS stored_count, count(*) AS violations, count(*) FILTER (WHERE coalesce(source_file, '') = '' OR source_row IS NULL) AS missing_lineage FROM ({all_rules_sql('daily')}) v",
        "extract_totals": "SELECT schema, count(*) AS records, count(DISTINCT source_file) AS files FROM vendor_records GROUP BY schema",
        "rows_as_json": "SELECT source_row, concat('{\"vendor\":\"', vendor, '\",\"schema_name\":\"', schema_name, '\",\"declared_column_count\":', declared_column_count, '}') AS row FROM vendor_record",
        "snapshots_from_json": "SELECT source_row, coalesce(currency, '') AS currency, instrument_id, 6 AS fields FROM pricing",
        "absent_columns": "SELECT source_row, array_to_string(l, ',') AS lacking, len(l) = 0 AS contains_all FROM (SELECT source_row, list_filter(['VENDOR_1', 'S1', 'USD'], lambda x: NOT list_contains([vendor, schema_name, currency], x)) AS l FROM vendor_record) v",
        "quarantine_csv": f"SELECT v.rule_name, v.owner_name, v.source_row, v.detail, p.instrument_id FROM ({price_rules}) v JOIN pricing p ON p.source_row = v.source_row",
        "audit_retry": f"SELECT run_id, rule_name, count(*) AS entries, count(*) AS reproduced FROM ({price_rules}) v CROSS JOIN (VALUES ('run-1'), ('run-2')) r(run_id) GROUP BY run_id, rule_name",
        "vintage_deliveries": "SELECT delivery_id, schema_name, count(*) AS records FROM vendor_record CROSS JOIN (VALUES ('d9'), ('d10')) d(delivery_id) WHERE delivery_id = 'd9' OR vendor IN ('VENDOR_0', 'VENDOR_2', 'VENDOR_4') GROUP BY delivery_id, schema_name",
        "vintage_latest_files": "SELECT source_file, CASE WHEN vendor IN ('VENDOR_0', 'VENDOR_2', 'VENDOR_4') THEN 'd10' ELSE 'd9' END AS delivery_id, count(*) AS records FROM vendor_record GROUP BY ALL",
        "json_vintages": f"SELECT 'daily_consolidated' AS schema, '{DAILY_DATE}' AS as_of_date, delivery_id, count(*) AS record_count FROM vendor_records CROSS JOIN (VALUES ('r1'), ('r2')) d(delivery_id) GROUP BY delivery_id",
        "staged_view": "SELECT currency, count(*) AS n FROM security_master GROUP BY currency",
        "restated_vintages": f"SELECT key, seq, abs(price) AS price, currency FROM ({_LAST_PRICES}) l",
        "cached_reads": f"SELECT key, CASE WHEN moved THEN -max_seq ELSE seq END AS seq FROM (SELECT key, min(seq) AS seq, max(seq) AS max_seq, bool_or(seq % 100 = 2) AS moved FROM (SELECT {_PRICE_KEY} AS key, source_row AS seq FROM pricing WHERE source_row % 50 = 2) p GROUP BY key) k",
        "price_reads": f"SELECT key, price FROM ({_LAST_PRICES}) l WHERE key IN (SELECT {_PRICE_KEY} FROM pricing WHERE source_row = 10)",
    }
    millis = "epoch_us(ts) // 1000"
    return {n: for_duckdb(s) for n, s in domain.items()} | {
        "corpus_counts": "SELECT name, cast(n as bigint) AS n, first_row, last_row FROM (VALUES ('pricing', 14400, 2, 14401), ('positions', 72000, 2, 72001), ('funds', 150, 2, 151)) t(name, n, first_row, last_row)",
        "corpus_defects": f"SELECT rule_name, cast(defects as bigint) AS defects, cast(defects as bigint) AS caught, cast(n as bigint) AS n FROM (VALUES {defects}) t(rule_name, defects, n)",
        "feed_consumed": f"SELECT concat('PRICE|', cast(user_id as varchar)) AS key, count(*) AS changes, max({millis}) AS last_changed_at FROM events GROUP BY user_id",
        "feed_windows": f"SELECT epoch_ms(date_trunc('day', ts)) AS window_start, count(*) AS changes FROM events GROUP BY date_trunc('day', ts)",
        "polling_comparison": f"SELECT count(*) AS samples, round(avg(event_id % 5), 4) AS push_ms, round(avg(((37 - ({millis})) % 200 + 200) % 200), 4) AS poll_ms FROM events",
    }
