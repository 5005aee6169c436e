"""Whole runs from files to stored results: the gate over a corpus, and a delivery of vendor feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators import quarantine as q
from ..schemas import feed_schema_table
from ..sources import files, sinks
from ..sources.staging import stored
from .daily_flow import DailyFlow
from .rules import FEED_RULES, GATE_RULES


def gate_run(spark: SparkSession, corpus_dir: str, out_dir: str, *, run_id: str, run_date: str, manifest: str | None = None) -> dict:
    """Load a corpus, quarantine what fails, log and replay the decisions, and score a manifest.

    ``out_dir`` gets ``quarantine`` (this run's), ``audit`` (all runs') and the returned figures'
    report. Only figures come back to the driver.
    """
    tables = files.read_gate_corpus(spark, corpus_dir)
    sinks.write_quarantine(q.quarantine(tables, GATE_RULES, run_id, run_date), f"{out_dir}/quarantine")
    found = spark.read.parquet(f"{out_dir}/quarantine")
    audit.append_audit(audit.audit_entries(found), f"{out_dir}/audit")
    entries = audit.read_audit(spark, f"{out_dir}/audit").where(f"run_id = '{run_id}'")
    total, missing = q.missing_lineage(found).first()
    replayed, reproduced = audit.replay_totals(audit.replay(entries, GATE_RULES)).first()
    figures = {"quarantined": total, "missing_lineage": missing, "replayed": replayed, "reproduced": reproduced, "report": sinks.report(found)}
    if manifest:
        seeded = files.read_defect_manifest(spark, manifest)
        figures["defects"], figures["caught"] = audit.recall(audit.score(seeded, found)).first()
        figures["false_positives"] = audit.false_positives(seeded, found).count()
    return figures


def ingest_feeds(spark: SparkSession, csv_dir: str, vintage_dir: str, *, delivery_id: str, strict: bool = True) -> int:
    """Append all vendor files of a directory as one immutable delivery; the number of its records."""
    records = files.read_vendor_feeds(spark, csv_dir, feed_schema_table(spark), strict=strict)
    sinks.append_vintage(records, vintage_dir, delivery_id)
    return files.read_vintages(spark, vintage_dir).where(f"delivery_id = '{delivery_id}'").count()


def seed_vintages(spark: SparkSession, corpus_dir: str, vintage_dir: str, *, recorded_at: str) -> int:
    """Load a corpus' masters, prices and positions as the first vintages of a store that is empty; the number stored.

    A store that holds vintages is left as it is, so starting again seeds nothing twice.
    """
    if stored(spark, vintage_dir) is None:
        loaded = files.load_vintages(files.read_gate_corpus(spark, corpus_dir), F.to_timestamp(F.lit(recorded_at)))
        loaded.write.parquet(vintage_dir)
    return spark.read.parquet(vintage_dir).count()


def daily_run(spark: SparkSession, vendor_dir: str, run_dir: str, vintage_dir: str, *, data_dir: str | None = None) -> dict:
    """The 55 tasks of a day, from where an earlier try of the same ``run_dir`` ended; its figures."""
    graph = DailyFlow(spark, vendor_dir, run_dir, vintage_dir, data_dir=data_dir).graph()
    outcome = graph.run()
    figures = {"executed": len(outcome.executed), "skipped": len(outcome.skipped)}
    return figures | graph.output("reconcile_checksum") | {"violations": graph.output("lineage_index")["total"]}


def check_feeds(vintages: DataFrame, instrument_master: DataFrame, run_date: str, *, latest_only: bool = False) -> DataFrame:
    """Violations of the 14 checks over stored vintages: all of them, or each file's last delivery."""
    spark = vintages.sparkSession
    records = files.latest_vintages(vintages) if latest_only else vintages
    bounds = feed_schema_table(spark).select("schema_name", "value1_upper_bound", "allow_negative_value1")
    return q.violations({"vendor_record": records, "instrument_master": instrument_master, "schema_bounds": bounds}, FEED_RULES, run_date)
