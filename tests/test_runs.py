"""Whole runs from files."""

from pyspark.sql import functions as F

from gatewright.operators import bitemporal
from gatewright.plans import runs
from gatewright.schemas import DAILY_COLUMNS, FEED_COLUMNS, GATE_TABLES
from gatewright.sources import corpus, files, sinks


def write_corpus(spark, tables, directory):
    for name, schema in GATE_TABLES.items():
        df = tables[name]
        for c in schema.fieldNames():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(1 if c == "source_row" else name + ".csv"))
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.fieldNames()]
        lines = [r[0] for r in df.select(F.concat_ws(",", *cells)).collect()]
        (directory / f"{name}.csv").write_text("\n".join([",".join(schema.fieldNames()), *lines]) + "\n")


def test_gate_run_from_files(spark, tmp_path):
    tables, manifest = corpus.gate_corpus(spark, days=30, defects=True)
    write_corpus(spark, tables, tmp_path)
    (tmp_path / "m.tsv").write_text("".join(f"{r['rule_name']}\t{';'.join(f'{a[0]}|{a[1]}' for a in r['anchors'])}\n" for r in manifest.collect()))
    out = runs.gate_run(spark, str(tmp_path), str(tmp_path / "out"), run_id="r1", run_date="2026-08-28", manifest=str(tmp_path / "m.tsv"))
    assert (out["defects"], out["caught"], out["missing_lineage"]) == (45, 45, 0)
    assert out["quarantined"] == out["replayed"] == out["reproduced"] == 1076
    again = runs.gate_run(spark, str(tmp_path), str(tmp_path / "out"), run_id="r1", run_date="2026-08-28")
    assert again["replayed"] == 1076 and "false_positives" not in again
    assert out["false_positives"] == 1076 - 50  # anchors: two for each pair


def test_feed_deliveries(spark, tmp_path):
    rows = corpus.feed_corpus(spark, files_per_schema=2, rows_per_file=60)
    sinks.write_named_csv(rows, str(tmp_path / "in"), list(FEED_COLUMNS), "at")
    for d in ("d1", "d2"):
        assert runs.ingest_feeds(spark, str(tmp_path / "in"), str(tmp_path / "v"), delivery_id=d) == 40 * 2 * 60
    stored, master = files.read_vintages(spark, str(tmp_path / "v")), corpus.instrument_master(spark)
    # A restated file repeats its records: over all vintages they are duplicates, over the last none is.
    assert {r["rule_name"] for r in runs.check_feeds(stored, master, "2026-10-05").select("rule_name").distinct().collect()} == {"duplicate_row"}
    assert runs.check_feeds(stored, master, "2026-10-05", latest_only=True).count() == 0


def test_reads_and_restatement(spark):
    tables, _ = corpus.gate_corpus(spark, days=2)
    v = files.load_vintages({k: tables[k].where("instrument_id = 'INS-0001'") for k in ("security_master", "pricing", "positions")}, F.to_timestamp(F.lit("2026-08-28")))
    day = str(tables["pricing"].first()["price_date"])
    assert bitemporal.latest_of(v, "SM", "INS-0001").count() == 1 and bitemporal.latest_of(v, "SM", "nobody").count() == 0
    assert bitemporal.latest_of(v, "POS", "F01", "INS-0001", day).count() == 1
    after, before_n, after_n = bitemporal.restate_price(v, "INS-0001", day, "9.99", F.to_timestamp(F.lit("2026-08-29")), F.lit(1))
    assert (before_n, after_n) == (1, 2)
    assert bitemporal.latest_of(after, "PRICE", "INS-0001", day).first()["payload"]["price"] == "9.99"


def test_seeding_and_a_day(spark, tmp_path):
    tables, _ = corpus.gate_corpus(spark, days=2)
    (tmp_path / "corpus").mkdir()
    write_corpus(spark, tables, tmp_path / "corpus")
    n = sum(tables[t].count() for t in ("security_master", "pricing", "positions"))
    for _ in range(2):  # the second start finds the store seeded
        assert runs.seed_vintages(spark, str(tmp_path / "corpus"), str(tmp_path / "store"), recorded_at="2026-08-28") == n
    rows = corpus.daily_corpus(spark).where("source_file LIKE 'equity_us%' OR source_file LIKE 'bond_us%'")
    sinks.write_named_csv(rows, str(tmp_path / "in"), list(DAILY_COLUMNS), "at")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "run"), str(tmp_path / "published"))
    first = runs.daily_run(*args, data_dir=f"file://{tmp_path}/tables")
    again = runs.daily_run(*args, data_dir=f"file://{tmp_path}/tables")
    assert (first["executed"], first["skipped"], again["executed"], again["skipped"]) == (55, 0, 0, 55)
    assert first["record_count"] == rows.count() and again["checksum"] == first["checksum"]
    assert first["violations"] == 33  # the schemas without files
    assert files.read_json_vintages(spark, str(tmp_path / "published")).count() == 1
