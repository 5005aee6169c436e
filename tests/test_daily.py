"""Daily rules, the task graph and the 55-task flow."""

import pytest
from pyspark.sql import functions as F

from gatewright.operators import quarantine as q
from gatewright.plans import dag
from gatewright.plans.daily_flow import DailyFlow
from gatewright.plans.rules import DAILY_DATE, DAILY_RULES
from gatewright.schemas import DAILY_COLUMNS, DAILY_RECORD, FILE_MANIFEST, daily_schema_table
from gatewright.sources import corpus, files, sinks

BASE = dict(as_of_date="2026-10-05", instrument_id="EQU00001", value1=100.0, value2=0.5, currency="USD", source_vendor="vendor_a", schema="equity_us", source_file="equity_us_000.csv", source_row=0, asset_class="equity", allow_negative_value1=False, value1_min=0.0, value1_max=100000.0)

OVERRIDES = {
    "missing_instrument_id": {"instrument_id": " "},
    "missing_currency": {"currency": ""},
    "missing_as_of_date": {"as_of_date": None},
    "missing_value1": {"value1": None},
    "missing_value2": {"value2": None},
    "missing_source_vendor": {"source_vendor": ""},
    "value1_below_schema_min": {"value1": -1.0},
    "value1_above_schema_max": {"value1": 100001.0},
    "value1_negative_when_disallowed": {"value1": -0.5},
    "value1_gross_outlier_10x_max": {"value1": 1e7},
    "value2_below_zero": {"value2": -0.1},
    "value2_above_one": {"value2": 1.5},
    "non_usd_currency": {"currency": "EUR"},
    "unknown_source_vendor": {"source_vendor": "vendor_x"},
    "stale_as_of_date_past": {"as_of_date": "2026-10-04"},
    "future_dated_record": {"as_of_date": "2026-10-06"},
    "instrument_id_wrong_prefix": {"instrument_id": "BON00001"},
    "source_row_negative": {"source_row": -1},
    "source_file_blank": {"source_file": ""},
    "schema_label_mismatch": {"source_file": "bond_us_000.csv"},
    "currency_not_three_letters": {"currency": "US"},
    "instrument_id_wrong_length": {"instrument_id": "EQU1"},
    "value1_exactly_zero": {"value1": 0.0},
    "as_of_date_wrong_format": {"as_of_date": "2026/10/05"},
    "value2_is_integer_valued": {"value2": 1.0},
}


def records(spark, *overs):
    return spark.createDataFrame([tuple({**BASE, **o}[n] for n in DAILY_RECORD.fieldNames()) for o in overs], DAILY_RECORD)


def fired(tables, anchor="vendor_records"):
    return {r["rule_name"] for r in q.violations(tables, [r for r in DAILY_RULES if r.anchor == anchor], DAILY_DATE).collect()}


@pytest.mark.parametrize("rule", sorted(OVERRIDES))
def test_each_row_rule_fires(spark, rule):
    assert rule in fired({"vendor_records": records(spark, OVERRIDES[rule])})


def test_duplicates_and_a_clean_set(spark):
    assert fired({"vendor_records": records(spark, {}, {"source_row": 1})}) == {"duplicate_instrument_within_file"}
    clean = [{"instrument_id": f"EQU{i:05d}", "source_row": i} for i in range(10)]
    assert fired({"vendor_records": records(spark, *clean)}) == set()
    assert {r.name for r in DAILY_RULES if r.anchor == "vendor_records"} == set(OVERRIDES) | {"duplicate_instrument_within_file"}
    assert len(DAILY_RULES) == 30


def test_file_and_schema_rules(spark):
    rows = [("equity_us", f"equity_us_{i:03d}.csv", n) for i, n in enumerate([0, 14, 15, 16])]
    manifest = spark.createDataFrame(rows, FILE_MANIFEST)
    got = sorted((r["rule_name"], r["source_file"]) for r in q.violations({"file_manifest": manifest}, [r for r in DAILY_RULES if r.level != "row"], DAILY_DATE).collect())
    assert got == [("empty_file", "equity_us_000.csv"), ("file_count_below_expected", ""), ("row_count_anomaly_high", "equity_us_003.csv"), ("row_count_anomaly_low", "equity_us_001.csv")]
    # With the expected schemas given, one without any file is seen too.
    schemas = daily_schema_table(spark)
    n = q.violations({"file_manifest": manifest, "schemas": schemas}, [r for r in DAILY_RULES if r.level == "schema"], DAILY_DATE).count()
    assert n == 35


def test_reader_keeps_quotes_and_empty_values(spark, tmp_path):
    (tmp_path / "equity_us_000.csv").write_text('as_of_date,instrument_id,value1,value2,currency,source_vendor\n2026-10-05,"EQU,0001",1.5,,"USD",vendor_a\n2026-10-05,EQU2\n')
    (tmp_path / "equity_us_001.csv").write_text("as_of_date,instrument_id,value1,value2,currency,source_vendor\n")
    got = [tuple(r) for r in files.read_daily_files(spark, str(tmp_path)).orderBy("source_row").collect()]
    assert got[0] == ("2026-10-05", "EQU,0001", "1.5", "", "USD", "vendor_a", "equity_us", "equity_us_000.csv", 0)
    assert got[1][:4] == ("2026-10-05", "EQU2", "", "")
    landed = files.read_daily_files(spark, str(tmp_path))
    manifest = {(r["file_name"], r["row_count"]) for r in files.daily_manifest(spark, str(tmp_path), landed).collect()}
    assert manifest == {("equity_us_000.csv", 2), ("equity_us_001.csv", 0)}
    typed = files.typed_daily_records(landed, daily_schema_table(spark)).orderBy("source_row").collect()
    assert typed[0]["value1"] == 1.5 and typed[0]["value2"] is None and typed[1]["value1"] is None
    bad = landed.withColumn("value1", F.lit("x"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.typed_daily_records(bad, daily_schema_table(spark)).collect()


def toy(log):
    def run(name, value):
        def go(given):
            log.append(name)
            return {"value": value + sum(x["value"] for x in given.values())}

        return go

    return [dag.Task("c", ("a", "b"), run("c", 1)), dag.Task("a", (), run("a", 10)), dag.Task("b", ("a",), run("b", 100)), dag.Task("d", ("c",), run("d", 0))]


def test_graph_runs_in_order_and_resumes(tmp_path):
    log = []
    g = dag.Graph(str(tmp_path / "x"), toy(log))
    with pytest.raises(dag.SimulatedCrash):
        g.run(crash_after="b")
    assert log == ["a", "b"]
    outcome = dag.Graph(str(tmp_path / "x"), toy(log)).run()
    assert outcome.skipped == ["a", "b"] and outcome.executed == ["c", "d"]
    assert dag.Graph(str(tmp_path / "x"), toy(log)).run().executed == [] and log == ["a", "b", "c", "d"]
    whole = dag.Graph(str(tmp_path / "y"), toy([]))
    whole.run()
    assert {n: whole.output(n) for n in "abcd"} == {n: g.output(n) for n in "abcd"}


def test_graph_refuses_cycles_and_unknown_tasks(tmp_path):
    with pytest.raises(ValueError, match="cycle"):
        dag.in_order([dag.Task("a", ("b",), dict), dag.Task("b", ("a",), dict)])
    with pytest.raises(KeyError):
        dag.in_order([dag.Task("a", ("z",), dict)])


def test_the_daily_flow_crashes_and_resumes(spark, tmp_path):
    sinks.write_named_csv(corpus.daily_corpus(spark), str(tmp_path / "in"), list(DAILY_COLUMNS), "at")
    make = lambda: DailyFlow(spark, str(tmp_path / "in"), str(tmp_path / "run"), str(tmp_path / "vintages")).graph()
    assert len(make().order) == 55
    with pytest.raises(dag.SimulatedCrash):
        make().run(crash_after="validate_group_4")
    assert len(make().done()) == 42
    outcome = make().run()
    assert len(outcome.executed) == 13 and len(outcome.skipped) == 42
    g = make()
    assert g.output("consolidate")["record_count"] == 23100 and g.output("consolidate")["file_count"] == 1540
    assert g.output("quarantine")["count"] == 0 and g.output("lineage_index") == {"total": 0, "missing_lineage": 0}
    published = files.read_json_vintages(spark, str(tmp_path / "vintages")).collect()
    assert len(published) == 1 and published[0]["payload"]["record_count"] == "23100"
