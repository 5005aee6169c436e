"""Vendor feeds: the drift-tolerant reader, vintages, the 14 checks and 500 seeded defects."""

import pytest
from pyspark.sql import functions as F

from gatewright.operators import quarantine as q
from gatewright.plans.rules import FEED_RULES
from gatewright.schemas import FEED_COLUMNS, feed_schema_table
from gatewright.sources import corpus, files, sinks

RUN_DATE = "2026-10-05"
HEADER = ",".join(FEED_COLUMNS)


def write(path, name, *lines):
    (path / name).write_text("\n".join(lines) + "\n")


def test_reader_maps_by_each_files_own_header(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, "I1,2026-10-04,2026-10-05,USD,1.5,2,ACTIVE,US,V,equity_vendor_feed_1", "", "I2,2026-10-04")
    write(tmp_path, "b.csv", "schema_name,vendor,instrument_id,extra,value1,value1", "fx_vendor_feed_3,W,I9,zz,7,8")
    write(tmp_path, "c.csv", HEADER.replace("value2,", ""), "I3,2026-10-04,2026-10-05,USD,1.5,ACTIVE,US,V,equity_vendor_feed_1\r")
    got = {(r["source_file"], r["source_row"]): r for r in files.read_vendor_feeds(spark, str(tmp_path), strict=True).collect()}
    assert set(got) == {("a.csv", 1), ("a.csv", 2), ("a.csv", 3), ("b.csv", 1), ("c.csv", 1)}
    assert got["a.csv", 2]["instrument_id"] == "" and got["a.csv", 3]["value1"] == ""
    b = got["b.csv", 1]
    assert (b["instrument_id"], b["value1"], b["as_of_date"], b["actual_column_count"], b["missing_required_column"]) == ("I9", "8", "", 6, True)
    assert got["c.csv", 1]["value2"] == "" and not got["c.csv", 1]["missing_required_column"]


def test_files_without_a_schema(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, "I1,2026-10-04,2026-10-05,USD,1.5,2,ACTIVE,US,V,equity_vendor_feed_1")
    write(tmp_path, "only_header.csv", HEADER)
    write(tmp_path, "unknown.csv", HEADER, "I1,2026-10-04,2026-10-05,USD,1.5,2,ACTIVE,US,V,nobody")
    schemas = feed_schema_table(spark)
    assert {r["source_file"] for r in files.read_vendor_feeds(spark, str(tmp_path), schemas, strict=False).collect()} == {"a.csv"}
    assert {r["source_file"] for r in files.rejected_feeds(spark, str(tmp_path), schemas).collect()} == {"only_header.csv", "unknown.csv"}
    with pytest.raises(Exception, match="schema_name"):
        files.read_vendor_feeds(spark, str(tmp_path), schemas).collect()


def test_files_are_read_block_by_block(spark, tmp_path):
    """No row holds a file, and rows of files of many blocks keep their numbers."""
    for name, n in (("a.csv", 700), ("b.csv", 1), ("c.csv", 90)):
        write(tmp_path, name, HEADER, *[f"{name}{i},2026-10-04,2026-10-05,USD,{i},2,ACTIVE,US,V,equity_vendor_feed_1" if i % 7 else "" for i in range(1, n + 1)])
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lines = files.read_numbered_lines(spark, str(tmp_path))
        records = files.read_vendor_feeds(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert lines.agg(F.max(F.length("line"))).first()[0] < 100 and lines.count() == 794
    assert sorted((r["source_file"], r["source_row"]) for r in records) == sorted((name, i) for name, n in (("a.csv", 700), ("b.csv", 1), ("c.csv", 90)) for i in range(1, n + 1))
    assert all(r["value1"] == (str(r["source_row"]) if r["source_row"] % 7 else "") for r in records)


def test_feeds_query_over_a_table_whose_first_split_has_no_rows(spark, tmp_path):
    from gatewright.plans.io_queries import source_vendor_feeds

    spark.range(1, 3001).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # one group of rows, in the middle of the splits
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = source_vendor_feeds(spark, str(tmp_path))
        for k, v in before.items():
            spark.conf.set(k, v)
        assert got.count() == 3000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_vintages_are_immutable(spark, tmp_path):
    rows = corpus.feed_corpus(spark, files_per_schema=1, rows_per_file=2).where("schema_name = 'equity_vendor_feed_1'")
    sinks.write_named_csv(rows, str(tmp_path / "in"), list(FEED_COLUMNS), "at")
    records = files.read_vendor_feeds(spark, str(tmp_path / "in"))
    for delivery in ("d9", "d10", "d9", "d10"):  # the later ones are retries; as texts, d9 is the larger
        sinks.append_vintage(records, str(tmp_path / "v"), delivery)
    stored = files.read_vintages(spark, str(tmp_path / "v"))
    assert stored.count() == 4 and stored.select("delivery_id").distinct().count() == 2
    assert files.latest_vintages(stored).select("delivery_id").distinct().collect()[0][0] == "d10"
    assert files.latest_vintages(stored).drop("delivery_id", "delivered_at").exceptAll(records.select(*stored.drop("delivery_id", "delivered_at").columns)).isEmpty()


def tables_of(spark, records):
    bounds = feed_schema_table(spark).select("schema_name", "value1_upper_bound", "allow_negative_value1")
    return {"vendor_record": records, "instrument_master": corpus.instrument_master(spark), "schema_bounds": bounds}


def test_seeded_defects(spark, tmp_path):
    rows, manifest = corpus.feed_defects(spark)
    assert manifest.count() == 500
    n = sinks.write_named_csv(rows, str(tmp_path / "in"), [*FEED_COLUMNS, "unexpected_extra_column"], "at")
    assert n == 290
    records = files.read_vendor_feeds(spark, str(tmp_path / "in"), feed_schema_table(spark))
    records.write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    assert records.count() == 36176
    found = q.violations(tables_of(spark, records), FEED_RULES, RUN_DATE, snapshots=False).select(F.col("rule_name").alias("check"), "source_file", "source_row")
    found.write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    key = ["check", "source_file", "source_row"]
    assert manifest.join(found, key, "left_anti").count() == 0
    # What is found beside: the original of a copied row, a late row as stale, a missing column as
    # missing field, -100 beyond a small bound, and the few rows of the special files.
    extra = found.join(manifest, key, "left_anti")
    original = manifest.where("`check` = 'duplicate_row'").withColumn("source_row", F.col("source_row") - 1)
    late = manifest.where("`check` in ('late_arriving_record', 'stale_feed')").select(F.explode(F.array(F.lit("stale_feed"), F.lit("late_arriving_record"))).alias("check"), "source_file", "source_row")
    absent = manifest.where("`check` = 'schema_drift_missing_column'").withColumn("check", F.lit("missing_required_field"))
    beyond = manifest.where("`check` = 'negative_value'").withColumn("check", F.lit("value_out_of_range"))
    short = extra.where("`check` = 'row_count_anomaly' and (source_file like '%drift%' or source_file like '%disagree%')")
    explained = original.select(key).unionByName(late).unionByName(absent.select(key)).unionByName(beyond.select(key)).unionByName(short.select(key))
    drift = extra.where("`check` = 'schema_drift_column_count'").join(manifest.where("`check` = 'schema_drift_missing_column'").select("source_file", "source_row"), ["source_file", "source_row"], "left_semi")
    assert extra.join(explained, key, "left_anti").join(drift, key, "left_anti").count() == 0


def test_clean_feeds(spark, tmp_path):
    rows = corpus.feed_corpus(spark, files_per_schema=3, rows_per_file=60)
    sinks.write_named_csv(rows, str(tmp_path / "in"), list(FEED_COLUMNS), "at")
    records = files.read_vendor_feeds(spark, str(tmp_path / "in"))
    assert records.count() == 40 * 3 * 60
    assert q.violations(tables_of(spark, records), FEED_RULES, RUN_DATE, snapshots=False).count() == 0


def record(**over):
    base = dict(source_file="f.csv", source_row=1, vendor="V", schema_name="equity_vendor_feed_1", instrument_id="INST-00001", as_of_date="2026-10-04", received_at="", currency="USD", value1="5", value2="", declared_column_count=10, actual_column_count=10, missing_required_column=False)
    return {**base, **over}


@pytest.mark.parametrize(
    ("over", "check"),
    [
        ({"instrument_id": " "}, "missing_required_field"),
        ({"as_of_date": "2026-10-06"}, "future_dated_record"),
        ({"as_of_date": "2026-09-29"}, "stale_feed"),
        ({"value1": "abc"}, "type_mismatch"),
        ({"value1": "-1"}, "negative_value"),
        ({"value1": "10001"}, "value_out_of_range"),
        ({"currency": "zzz"}, "invalid_currency_code"),
        ({"instrument_id": "INST-9"}, "orphan_instrument_reference"),
        ({"actual_column_count": 9}, "schema_drift_column_count"),
        ({"missing_required_column": True}, "schema_drift_missing_column"),
        ({"as_of_date": "2026-1-5"}, None),
        ({"value1": ""}, None),
    ],
)
def test_each_row_check(spark, over, check):
    from gatewright.schemas import VENDOR_RECORD

    df = spark.createDataFrame([tuple(record(**over)[f] for f in VENDOR_RECORD.fieldNames())], VENDOR_RECORD)
    names = {r["rule_name"] for r in q.violations(tables_of(spark, df), FEED_RULES, RUN_DATE, snapshots=False).collect()}
    assert names == ({check} if check else set())
