"""Audit log: append once for each run, replay decisions from snapshots, score against a manifest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import Rule, SnapshotFields
from ..schemas import AUDIT


def audit_entries(quarantined: DataFrame, decision: str = "QUARANTINE") -> DataFrame:
    return quarantined.select("quarantine_id", "rule_name", "snapshot", F.lit(decision).alias("decision"), "run_id", F.col("detected_at").alias("created_at"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append a run to the log. Writing the same run again replaces it, so a retry adds nothing."""
    stored = entries.withColumn("snapshot", F.to_json("snapshot"))
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.select(*[F.from_json("snapshot", "map<string,string>").alias(f.name) if f.name == "snapshot" else F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT.fields])


def replay(entries: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Every entry with ``reproduced``: whether its rule fires again on its snapshot alone."""
    fields = SnapshotFields()
    again = F.coalesce(*[F.when(F.col("rule_name") == r.name, F.coalesce(r.predicate(fields), F.lit(False))) for r in rules], F.lit(False))
    return entries.withColumn("reproduced", again)


def replay_totals(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.count("*").alias("total"), F.count_if("reproduced").alias("reproduced"))


def score(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Every seeded defect with ``caught``: all its anchors were found by its rule.

    The manifest has (defect_id, rule_name, anchors), anchors an array of (source_file,
    source_row). A defect without anchors is not caught.
    """
    keys = found.select(F.col("rule_name").alias("_r"), F.col("source_file").alias("_f"), F.col("source_row").alias("_n")).distinct().withColumn("_hit", F.lit(True))
    each = manifest.select("defect_id", "rule_name", F.explode_outer("anchors").alias("a"))
    joined = each.join(keys, (F.col("rule_name") == F.col("_r")) & (F.col("a.source_file") == F.col("_f")) & (F.col("a.source_row") == F.col("_n")), "left")
    return joined.groupBy("defect_id", "rule_name").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("caught"))


def companions(rows: DataFrame, back: int = 1) -> DataFrame:
    """(rule_name, source_file, source_row) of the rows ``back`` places before the given ones in their files."""
    return rows.select("rule_name", "source_file", (F.col("source_row") - back).alias("source_row"))


def with_companion(records: DataFrame, columns: list[str], back: int = 1) -> DataFrame:
    """Records with ``companion_<column>`` of the row ``back`` places before in the same file; null where there is none."""
    before = records.select(F.col("source_file").alias("_f"), (F.col("source_row") + back).alias("_r"), *[F.col(c).alias(f"companion_{c}") for c in columns])
    return records.join(before, (F.col("source_file") == F.col("_f")) & (F.col("source_row") == F.col("_r")), "left").drop("_f", "_r")


def false_positives(manifest: DataFrame, found: DataFrame, companions_of: tuple[str, ...] = ()) -> DataFrame:
    """Distinct found rows that no anchor of the manifest names for that rule.

    For rules in ``companions_of`` the row before an anchor is named too: of two equal rows
    neither can be told to be the copy.
    """
    named = manifest.select("rule_name", F.explode("anchors").alias("a")).select("rule_name", "a.source_file", "a.source_row")
    if companions_of:
        named = named.unionByName(companions(named.where(F.col("rule_name").isin(*companions_of))))
    return found.select("rule_name", "source_file", "source_row").distinct().join(named, ["rule_name", "source_file", "source_row"], "left_anti")


def recall(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("defects"), F.count_if("caught").alias("caught"))
