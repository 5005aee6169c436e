"""Gate rules: the miniature fixture, clean and defective corpora, audit and scoring."""

import pytest
from pyspark.sql import functions as F

from gatewright.operators import audit, compare
from gatewright.operators import quarantine as q
from gatewright.plans.rules import GATE_RULES
from gatewright.sources import corpus, files, sinks

RUN_DATE = "2026-08-28"

_MASTER = "instrument_id,cusip,isin,instrument_name,asset_class,currency,country,sector,benchmark_id,maturity_date,coupon_rate,source_file,source_row"
#: A small corpus of its own: six instruments, one fund, twenty violations; a blank line and absent cusips besides.
FIXTURE = {
    "security_master": f"""{_MASTER}
QX-10,CU-10,,Harbor,Equity,EUR,DE,Maritime,BM-ONE,,,security_master.csv,2
QX-11,CU-11,,Meadow,Equity,USD,US,,BM-ONE,,,security_master.csv,3
QX-12,CU-12,,Copper,Bond,USD,US,,,2031-05-01,0.35,security_master.csv,4
QX-13,CU-13,,Lantern,Bond,ZZZ,US,,,,0.02,security_master.csv,5
QX-14,,,Pebble,,USD,US,,,,,security_master.csv,6
QX-15,,,Thicket,Cash,USD,US,,,,,security_master.csv,7
""",
    "pricing": """instrument_id,price_date,price,currency,source_file,source_row
QX-10,2026-08-27,20.00,EUR,pricing.csv,2
QX-10,2026-08-28,33.00,EUR,pricing.csv,3
QX-11,2026-08-28,0,USD,pricing.csv,4
QX-12,2026-08-28,99.5,USD,pricing.csv,5

QX-13,2026-08-28,98,ZZZ,pricing.csv,6
QX-14,2026-09-15,7,USD,pricing.csv,7
""",
    "positions": """fund_id,instrument_id,position_date,quantity,market_value,local_currency,source_file,source_row
F77,QX-10,2026-08-28,100,3300,EUR,positions.csv,2
F77,QX-10,2026-08-28,100,3300,EUR,positions.csv,3
F77,QX-12,2026-08-28,-4,-398,USD,positions.csv,4
F77,QX-15,2026-08-28,-500,-500,USD,positions.csv,5
F77,QX-11,2026-08-27,1,1,GBP,positions.csv,6
""",
    "funds": "fund_id,fund_name,nav_date,reported_nav,source_file,source_row\nF77,Fund,2026-08-28,5702,funds.csv,2\nF77,Fund,2026-08-27,2,funds.csv,3\n",
    "fx_rates": "currency_code,rate_date,fx_rate_to_base,source_file,source_row\nEUR,2026-08-28,1.08,fx_rates.csv,2\n",
    "ref_benchmarks": "benchmark_id,benchmark_name\nBM-ONE,x\n",
    "ref_currency": "currency_code,currency_name\nUSD,x\nEUR,y\nGBP,z\n",
}
FIXTURE_COUNTS = {
    **dict.fromkeys(("missing_sector_for_equity", "coupon_rate_out_of_range_for_bond", "invalid_currency_code", "missing_maturity_date_for_bond", "missing_asset_class"), 1),
    **dict.fromkeys(("missing_price", "price_band_breach", "zero_price", "future_dated_price", "negative_position_quantity"), 1),
    **dict.fromkeys(("fx_rate_missing_for_nonbase_currency", "holdings_to_nav_tie_out"), 1),
    "stale_price": 4,
    "duplicate_position_row": 2,
    "position_date_mismatch": 2,
}


def by_rule(found):
    return {r["rule_name"]: r["n"] for r in q.counts_by_rule(found).collect()}


def test_miniature_fixture(spark, tmp_path):
    for name, text in FIXTURE.items():
        (tmp_path / f"{name}.csv").write_text(text)
    tables = files.read_gate_corpus(spark, str(tmp_path))
    found = q.quarantine(tables, GATE_RULES, "r1", RUN_DATE)
    assert by_rule(found) == FIXTURE_COUNTS
    rows = found.collect()
    assert all(r["source_file"] and r["source_row"] and r["owner_name"] for r in rows)
    replayed = audit.replay(audit.audit_entries(found), GATE_RULES)
    assert tuple(audit.replay_totals(replayed).first()) == (20, 20)


def test_a_fund_date_without_positions_is_off(spark, tmp_path):
    for name, text in FIXTURE.items():
        (tmp_path / f"{name}.csv").write_text(text + ("F77,Fund,2026-08-20,77,funds.csv,4\nF77,Fund,2026-08-19,,funds.csv,5\n" if name == "funds" else ""))
    tables = files.read_gate_corpus(spark, str(tmp_path))
    rows = [r for r in q.violations(tables, GATE_RULES, RUN_DATE).collect() if r["rule_name"] == "holdings_to_nav_tie_out"]
    assert sorted(r["source_row"] for r in rows) == [3, 4, 5]


def test_clean_corpus_has_no_violations(spark):
    tables, manifest = corpus.gate_corpus(spark, days=30)
    assert manifest is None
    assert (tables["pricing"].count(), tables["positions"].count(), tables["funds"].count()) == (14400, 72000, 150)
    assert by_rule(q.violations(tables, GATE_RULES, RUN_DATE, snapshots=False)) == {}
    rows = tables["positions"].agg(F.min("source_row"), F.max("source_row"), F.countDistinct("source_row")).first()
    assert tuple(rows) == (2, 72001, 72000)


def test_seeded_defects_are_all_found_and_replayed(spark, tmp_path):
    tables, manifest = corpus.gate_corpus(spark, days=30, defects=True)
    assert (tables["pricing"].count(), tables["positions"].count()) == (14328, 72002)
    found = q.quarantine(tables, GATE_RULES, "run-7", RUN_DATE)
    sinks.write_quarantine(found, str(tmp_path / "quarantine"))
    stored = spark.read.parquet(str(tmp_path / "quarantine"))
    assert by_rule(stored) == {
        **{r.name: 2 for r in GATE_RULES},
        "stale_price": 476,
        "price_band_breach": 4,
        "price_currency_mismatch": 122,
        "duplicate_identifier": 6,
        "duplicate_position_row": 4,
        "matured_bond_still_priced": 60,
        "position_date_mismatch": 374,
    }
    assert tuple(audit.recall(audit.score(manifest, stored)).first()) == (45, 45)
    assert tuple(q.missing_lineage(stored).first()) == (stored.count(), 0)
    log = str(tmp_path / "audit")
    for _ in range(2):  # a retry of the same run adds nothing
        audit.append_audit(audit.audit_entries(stored), log)
    audit.append_audit(audit.audit_entries(stored).withColumn("run_id", F.lit("run-8")), log)
    entries = audit.read_audit(spark, log)
    n = stored.count()
    assert tuple(audit.replay_totals(audit.replay(entries, GATE_RULES)).first()) == (2 * n, 2 * n)
    assert stored.select("quarantine_id").distinct().count() == n
    assert "total" in sinks.report(stored)
    sinks.write_quarantine_csv(stored, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == n


def test_replay_reads_the_snapshot_only(spark):
    tables, _ = corpus.gate_corpus(spark, days=30, defects=True)
    found = q.quarantine({**tables}, [r for r in GATE_RULES if r.name == "negative_price"], "r", RUN_DATE)
    broken = audit.audit_entries(found).withColumn("snapshot", F.map_concat(F.map_filter("snapshot", lambda k, v: k != "price"), F.create_map(F.lit("price"), F.lit("5.0"))))
    assert tuple(audit.replay_totals(audit.replay(broken, GATE_RULES)).first()) == (2, 0)


def test_scoring_wants_all_anchors(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tf|2;f|3\na\tf|2\nb\tf|2\nc\t\n")
    manifest = files.read_defect_manifest(spark, str(tmp_path / "m.tsv"))
    found = spark.createDataFrame([("a", "f", 2), ("b", "g", 2)], "rule_name string, source_file string, source_row long")
    scored = {(r["rule_name"], r["defect_id"]): r["caught"] for r in audit.score(manifest, found).collect()}
    assert sorted(scored.values()) == [False, False, False, True]
    assert [tuple(r) for r in audit.false_positives(manifest, found).collect()] == [("b", "g", 2)]


def test_companions_of_copies_are_no_false_positives(spark):
    manifest = spark.createDataFrame([(1, "duplicate_row", [("f", 5)]), (2, "stale_feed", [("f", 9)])], "defect_id long, rule_name string, anchors array<struct<source_file:string,source_row:long>>")
    found = spark.createDataFrame([("duplicate_row", "f", 4), ("duplicate_row", "f", 5), ("stale_feed", "f", 8), ("stale_feed", "f", 9)], "rule_name string, source_file string, source_row long")
    assert sorted(tuple(r)[2] for r in audit.false_positives(manifest, found).collect()) == [4, 8]
    assert [tuple(r)[2] for r in audit.false_positives(manifest, found, ("duplicate_row",)).collect()] == [8]
    rows = audit.with_companion(found.where("rule_name = 'duplicate_row'"), ["rule_name"]).orderBy("source_row").collect()
    assert [r["companion_rule_name"] for r in rows] == [None, "duplicate_row"]


def test_rows_without_a_cusip_do_not_meet(spark):
    rows = [(f"I{k}", None if k % 2 else f"C{k % 4}", "Cash", "USD", "f", k) for k in range(40)]
    master = spark.createDataFrame(rows, "instrument_id string, cusip string, asset_class string, currency string, source_file string, source_row int")
    found = q.violations({"security_master": master}, [r for r in GATE_RULES if r.name == "duplicate_identifier"], RUN_DATE).collect()
    assert sorted(r["source_row"] for r in found) == [k for k in range(40) if k % 2 == 0]


def test_predicates_are_evaluated_once(spark):
    rules = [r for r in GATE_RULES if r.name in ("negative_price", "zero_price")]
    tables, _ = corpus.gate_corpus(spark, days=2)
    plan = q.violations({"pricing": tables["pricing"]}, rules, RUN_DATE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN 0 END") == plan.count("THEN 1 END") == 1 and "Generate explode(array(CASE WHEN" in plan


def test_band_breach_bridges_non_positive_prices(spark):
    rows = [("I", d, p, "USD", "f", i) for i, (d, p) in enumerate([("2026-01-01", 100), ("2026-01-02", 0), ("2026-01-03", -3), ("2026-01-04", 151), ("2026-01-05", 150)])]
    pricing = spark.createDataFrame([(a, b, str(c), e, f, g) for a, b, c, e, f, g in rows], "instrument_id string, price_date string, price string, currency string, source_file string, source_row int").selectExpr("instrument_id", "cast(price_date as date) price_date", "cast(price as decimal(20,6)) price", "currency", "source_file", "source_row")
    rule = [r for r in GATE_RULES if r.name == "price_band_breach"]
    assert [r["source_row"] for r in q.violations({"pricing": pricing}, rule, RUN_DATE).collect()] == [3]


def test_unknown_category_has_no_owner():
    assert q.require_owner("pricing").startswith("Pricing")
    with pytest.raises(ValueError):
        q.require_owner("other")


def test_one_scan_for_all_rules_of_an_anchor(spark, tmp_path):
    tables, _ = corpus.gate_corpus(spark, days=5)
    tables["pricing"].write.parquet(str(tmp_path / "p"))
    pricing = spark.read.parquet(str(tmp_path / "p"))
    rules = [r for r in GATE_RULES if r.name in ("negative_price", "zero_price", "price_band_breach")]
    plan = q.violations({"pricing": pricing}, rules, RUN_DATE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_same_rows():
    class Rows:
        def __init__(self, rows):
            self.rows, self.columns = rows, ["a"]

        def select(self, _):
            return self

        def exceptAll(self, other):
            left = list(self.rows)
            for r in other.rows:
                if r in left:
                    left.remove(r)
            return Rows(left)

        def isEmpty(self):
            return not self.rows

    assert compare.same_rows(Rows([1, 1]), Rows([1, 1])) and not compare.same_rows(Rows([1, 1]), Rows([1]))
