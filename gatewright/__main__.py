"""Whole runs from the command line:

    python -m gatewright gate CORPUS OUT RUN_ID RUN_DATE [MANIFEST]
    python -m gatewright feeds CSV_DIR VINTAGES DELIVERY
    python -m gatewright seed CORPUS VINTAGES RECORDED_AT
    python -m gatewright daily VENDOR_DIR RUN_DIR VINTAGES [DATA_DIR]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import runs


def main(args: list[str]) -> int:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    match args:
        case ["gate", corpus, out, run_id, run_date, *more] if len(more) < 2:
            figures = runs.gate_run(spark, corpus, out, run_id=run_id, run_date=run_date, manifest=more[0] if more else None)
            print("\n".join(f"{k}: {v}" for k, v in figures.items() if k != "report"), figures["report"], sep="\n")
        case ["feeds", csv_dir, vintages, delivery]:
            print("records:", runs.ingest_feeds(spark, csv_dir, vintages, delivery_id=delivery))
        case ["seed", corpus, vintages, recorded_at]:
            print("vintages:", runs.seed_vintages(spark, corpus, vintages, recorded_at=recorded_at))
        case ["daily", vendor_dir, run_dir, vintages, *more] if len(more) < 2:
            figures = runs.daily_run(spark, vendor_dir, run_dir, vintages, data_dir=more[0] if more else None)
            print("\n".join(f"{k}: {v}" for k, v in figures.items()))
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
