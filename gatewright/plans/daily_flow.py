"""The daily flow: 55 tasks from vendor files to a published vintage.

All extracts share one scan of the files, written once; the ten validation groups share the
consolidated records; what passes between tasks is counts and paths.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quarantine import violations
from ..schemas import OWNERS, daily_schema_table, daily_schemas
from ..sources.files import daily_manifest, read_daily_files, typed_daily_records
from ..sources.sinks import append_json_vintage
from ..sources.staging import stored
from .dag import Graph, Task
from .rules import DAILY_DATE, DAILY_RULES

GROUPS = 10


class DailyFlow:
    """The tasks of one run. ``strict_reference`` builds the manifest from the records, so that
    empty files and schemas without files go unseen; otherwise it comes from the file listing.

    ``run_dir`` holds the driver's own marks, small JSON files on its disk. ``data_dir`` holds the
    tables, in any store that Spark reads; by default it lies in ``run_dir``."""

    def __init__(self, spark: SparkSession, vendor_dir: str, run_dir: str, vintage_dir: str, strict_reference: bool = False, data_dir: str | None = None):
        self.spark, self.vendor_dir, self.run_dir, self.vintage_dir, self.strict = spark, vendor_dir, run_dir, vintage_dir, strict_reference
        self.data_dir = data_dir or f"{run_dir.rstrip('/')}/data"
        self._tables: dict[str, DataFrame] | None = None
        self._counts: dict[str, tuple[int, int]] | None = None

    def _path(self, name: str) -> str:
        return f"{self.data_dir}/{name}"

    def _landed(self) -> dict[str, tuple[int, int]]:
        """Records and files of each schema, from the one scan that all extracts share."""
        if self._counts is None:
            if stored(self.spark, self._path("manifest")) is None:  # written last
                landed = read_daily_files(self.spark, self.vendor_dir)
                landed.write.mode("overwrite").parquet(self._path("landed"))
                daily_manifest(self.spark, self.vendor_dir, self.spark.read.parquet(self._path("landed"))).write.mode("overwrite").parquet(self._path("manifest"))
            rows = self.spark.read.parquet(self._path("manifest")).groupBy("schema").agg(F.sum("row_count").alias("records"), F.count("*").alias("files")).collect()
            self._counts = {r["schema"]: (r["records"], r["files"]) for r in rows}
        return self._counts

    def tables(self) -> dict[str, DataFrame]:
        """The consolidated records and the manifest, read from what is written: a resumed run has them too."""
        if self._tables is None:
            records = self.spark.read.parquet(self._path("records"))
            manifest = records.groupBy("schema", F.col("source_file").alias("file_name")).agg(F.count("*").alias("row_count")) if self.strict else self.spark.read.parquet(self._path("manifest"))
            self._tables = {"vendor_records": records, "file_manifest": manifest}
            if not self.strict:
                self._tables["schemas"] = daily_schema_table(self.spark)
        return self._tables

    def _extract(self, schema: str) -> dict:
        records, files = self._landed().get(schema, (0, 0))
        return {"schema": schema, "record_count": records, "file_count": files}

    def _consolidate(self, given: dict[str, dict]) -> dict:
        typed_daily_records(self.spark.read.parquet(self._path("landed")), daily_schema_table(self.spark)).write.mode("overwrite").parquet(self._path("records"))
        return {"record_count": sum(x["record_count"] for x in given.values()), "file_count": sum(x["file_count"] for x in given.values()), "path": self._path("records")}

    def _validate(self, group: int) -> dict:
        each = len(DAILY_RULES) // GROUPS
        rules = DAILY_RULES[group * each : (group + 1) * each]
        path = self._path(f"violations/group={group}")
        violations(self.tables(), rules, DAILY_DATE, snapshots=False).write.mode("overwrite").parquet(path)
        return {"group": group, "rules": [r.name for r in rules], "count": self.spark.read.parquet(path).count(), "path": path}

    def found(self) -> DataFrame:
        """All violations of the run."""
        return self.spark.read.parquet(*[self._path(f"violations/group={g}") for g in range(GROUPS)])

    def _lineage(self) -> dict:
        lacking = (F.coalesce("schema", F.lit("")) == "") | (F.coalesce("source_file", F.lit("")) == "")
        total, missing = self.found().agg(F.count("*"), F.count_if(lacking)).first()
        return {"total": total, "missing_lineage": missing}

    def _publish(self, given: dict[str, dict]) -> dict:
        payload = {"as_of_date": DAILY_DATE, "record_count": given["consolidate"]["record_count"], "file_count": given["consolidate"]["file_count"], "violation_count": given["lineage_index"]["total"]}
        delivery = os.path.basename(os.path.normpath(self.run_dir))
        row = self.spark.range(1).select(F.create_map(*[F.lit(str(x)) for kv in payload.items() for x in kv]).alias("payload"))
        append_json_vintage(row, self.vintage_dir, "daily_consolidated", DAILY_DATE, delivery)
        return {"path": self.vintage_dir, "delivery_id": delivery}

    def _reconcile(self, given: dict[str, dict]) -> dict:
        records = self.tables()["vendor_records"]
        n, checksum = records.agg(F.count("*"), F.bit_xor(F.xxhash64(*records.columns))).first()
        if n != given["consolidate"]["record_count"]:
            raise RuntimeError(f"{n} records are stored, {given['consolidate']['record_count']} were extracted")
        return {"record_count": n, "file_count": given["consolidate"]["file_count"], "checksum": checksum}

    def tasks(self) -> list[Task]:
        names = [s[0] for s in daily_schemas()]
        extracts, groups = [f"extract_{s}" for s in names], [f"validate_group_{g}" for g in range(GROUPS)]
        still = lambda value: lambda _: value
        return [
            Task("start", (), still({"status": "started", "as_of_date": DAILY_DATE})),
            *[Task(f"extract_{s}", ("start",), lambda _, s=s: self._extract(s)) for s in names],
            Task("consolidate", tuple(extracts), self._consolidate),
            *[Task(t, ("consolidate",), lambda _, g=g: self._validate(g)) for g, t in enumerate(groups)],
            Task("quarantine", tuple(groups), lambda given: {"count": sum(x["count"] for x in given.values()), "paths": [given[g]["path"] for g in groups]}),
            Task("lineage_index", ("quarantine",), lambda _: self._lineage()),
            Task("vintage_publish", ("consolidate", "lineage_index"), self._publish),
            Task("reconcile_checksum", ("vintage_publish", "consolidate"), self._reconcile),
            Task("checkpoint", ("reconcile_checksum",), still({"status": "checkpoint"})),
            Task("archive", ("checkpoint",), still({"archived": True})),
            Task("notify", ("archive",), still({"notified_owners": [o.split(" - ")[0] for o in OWNERS.values()]})),
            Task("end", ("notify",), still({"status": "end"})),
        ]

    def graph(self) -> Graph:
        return Graph(self.run_dir, self.tasks())
