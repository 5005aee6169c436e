"""Sinks: quarantine tables, immutable vintages, JSON deliveries, reports and named CSV files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quarantine import counts_by_rule


def write_quarantine(quarantined: DataFrame, path: str) -> None:
    """The quarantine of the current run, in place of the last one's."""
    quarantined.write.mode("overwrite").parquet(path)


def write_quarantine_csv(quarantined: DataFrame, path: str) -> None:
    """The same as CSV, with quoting where a field needs it and the snapshot as JSON."""
    flat = quarantined.withColumn("snapshot", F.to_json("snapshot"))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_vintage(records: DataFrame, path: str, delivery_id: str, delivered_at: Column | None = None) -> None:
    """Append a delivery of feed records, with the time that it came (now, by default).

    Other deliveries are never changed; writing the same one again replaces it, so a retry adds
    nothing. A delivery is a folder, not a file for each vendor file, so the table keeps files of
    a good size.
    """
    own = {"delivery_id": F.lit(delivery_id), "delivered_at": F.current_timestamp() if delivered_at is None else delivered_at}
    _put_parts(records.withColumns(own), "delivery_id", "schema_name").parquet(path)


def _put_parts(rows: DataFrame, *by: str):
    """A writer that replaces the parts (folders) that the rows are in, and no other."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def append_json_vintage(payload: DataFrame, path: str, schema: str, as_of_date: str, delivery_id: str) -> None:
    """Append one JSON delivery; payload is a map column of one or more rows. The same one again replaces it."""
    rows = payload.select("payload", F.lit(schema).alias("schema"), F.lit(as_of_date).alias("as_of_date"), F.lit(delivery_id).alias("delivery_id"))
    _put_parts(rows, "schema", "as_of_date", "delivery_id").json(path)


def report(found: DataFrame) -> str:
    """A text report of violations by rule. Its rows are as many as there are rules."""
    rows = counts_by_rule(found).collect()
    width = max((len(r["rule_name"]) for r in rows), default=4)
    return "\n".join([*(f"{r['rule_name']:<{width}} {r['n']:>10,}" for r in rows), f"{'total':<{width}} {sum(r['n'] for r in rows):>10,}"])


def write_named_csv(rows: DataFrame, directory: str, columns: list[str], order: str, header: str = "header") -> int:
    """Write generated rows as CSV files named by ``source_file``, for fixtures and generators.

    Spark does not name files, so the driver writes them, one file at a time. A row's line has
    the columns that its ``header`` array names.
    """
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    names = F.array(*map(F.lit, columns))
    line = F.array_join(F.transform(F.col(header), lambda h: F.get(cells, (F.array_position(names, h) - 1).cast("int"))), ",")
    files = rows.select("source_file", F.array_join(header, ",").alias("h"), F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).groupBy("source_file", "h").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    text = files.select("source_file", F.concat_ws("\n", "h", F.transform("xs", lambda x: x["l"]), F.lit("")).alias("text"))
    os.makedirs(directory, exist_ok=True)
    n = 0
    for r in text.toLocalIterator():
        with open(os.path.join(directory, r["source_file"]), "w", encoding="utf-8", newline="") as f:
            f.write(r["text"])
        n += 1
    return n
