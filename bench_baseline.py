"""

Corpora are generated once as Parquet under ``$BENCH_TMP`` (a temporary folder by default); each
figure is the second of two runs. ``bench.py`` runs these too. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from gatewright.operators import pnl
from gatewright.operators import quarantine as q
from gatewright.plans.rules import DAILY_DATE, DAILY_RULES, FEED_RULES, GATE_RULES
from gatewright.schemas import DAILY_RECORD, VENDOR_RECORD, daily_schema_table, feed_schema_table
from gatewright.sources import corpus


def jobs(spark: SparkSession, root: str) -> dict:
    """The jobs, by name, over corpora that are written under ``root``."""

    def stored(name: str, df):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    typed = lambda schema, own: [f"cast({own.get(f.name, f.name)} as {f.dataType.simpleString()}) {f.name}" for f in schema.fields]
    gate = {k: stored(k, v) for k, v in corpus.gate_corpus(spark, days=500)[0].items()}
    feed = corpus.feed_corpus(spark, files_per_schema=30, rows_per_file=1000)
    own = {"source_row": "at", "declared_column_count": "10", "actual_column_count": "10", "missing_required_column": "false"}
    records = stored("feed", feed.selectExpr(*typed(VENDOR_RECORD, own)))
    feeds = {"vendor_record": records, "instrument_master": stored("master", corpus.instrument_master(spark, 30 * 1000)), "schema_bounds": feed_schema_table(spark)}
    day = corpus.daily_corpus(spark).selectExpr("*", "regexp_extract(source_file, '^(.*)_', 1) schema", "at source_row").join(daily_schema_table(spark), "schema")
    daily_records = stored("daily", day.selectExpr(*typed(DAILY_RECORD, {})))
    manifest = daily_records.groupBy("schema", "source_file").count().selectExpr("schema", "source_file file_name", "`count` row_count")
    daily = {"vendor_records": daily_records, "file_manifest": manifest}
    return {
        "baseline_gate_22_rules_1200k": lambda: q.violations(gate, GATE_RULES, "2026-08-28"),
        "baseline_feed_14_checks_1200k": lambda: q.violations(feeds, FEED_RULES, "2026-10-05"),
        "baseline_daily_30_rules_23k": lambda: q.violations(daily, DAILY_RULES, DAILY_DATE),
        "baseline_pnl_tie_out_1200k": lambda: pnl.tie_out(gate["positions"]).where("mismatch"),
    }


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    taken, rows = {}, {}
    for name, job in jobs(spark, os.environ.get("BENCH_TMP") or tempfile.mkdtemp()).items():
        for _ in range(2):
            began = time.perf_counter()
            rows[name] = job().count()
            taken[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"seconds": taken, "violations": rows}))


if __name__ == "__main__":
    main()
