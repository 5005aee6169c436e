"""File sources: gate corpora, drift-tolerant vendor feeds, daily files, vintages, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DAILY_COLUMNS, DAILY_RECORD, FEED_COLUMNS, FEED_REQUIRED, GATE_TABLES, VENDOR_RECORD
from .staging import stage


def read_gate_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One gate file, typed. Columns are taken by name from the header; '' is null; a value that
    does not convert is null; short rows are filled up with nulls and empty lines skipped."""
    schema = GATE_TABLES[table]
    landed = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nullValue", "").csv(f"{path}/{table}.csv")
    for f in schema.fields:
        if f.name not in landed.columns:
            landed = landed.withColumn(f.name, F.lit(None).cast("string"))
    return landed.select(*[F.col(f.name).try_cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def read_gate_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The seven tables of a gate corpus directory."""
    return {name: read_gate_table(spark, path, name) for name in GATE_TABLES}


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Staging views over the tables, for rules written as SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def reload_table(df: DataFrame, path: str) -> None:
    """Idempotent bulk load: the target is replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def read_defect_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(defect_id, rule_name, anchors) of a TSV with ``file|row;file|row`` anchors."""
    raw = spark.read.schema("rule_name string, raw string").option("sep", "\t").csv(path)
    anchor = lambda x: F.struct(F.split_part(x, F.lit("|"), F.lit(1)).alias("source_file"), F.split_part(x, F.lit("|"), F.lit(2)).try_cast("bigint").alias("source_row"))
    anchors = F.transform(F.filter(F.split(F.coalesce("raw", F.lit("")), ";"), lambda x: x != ""), anchor)
    return raw.select(F.monotonically_increasing_id().alias("defect_id"), "rule_name", anchors.alias("anchors"))


def read_whole_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(source_file, lines) of the files directly under a directory, one row for each file.

    Only the last line end is dropped: empty lines inside a file stay lines.
    """
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    lines = F.split("value", "\r?\n")
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return raw.select(F.col("_metadata.file_name").alias("source_file"), kept.alias("lines"))


def read_numbered_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, source_file, at, line) of the files directly under a directory, one row for each line; at is 0 for a file's first.

    A file is read block by block and never held whole. Blocks depend on the cores at hand, so the lines
    are written once to the shared folder before they are counted.
    """
    raw = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    block = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("start")]
    lines = stage(raw.select(*block, F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"\r\z", "").alias("line")), "lines")
    blocks = lines.groupBy("path", "start").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = blocks.select("path", "start", (before - F.col("first")).alias("shift"))
    return lines.join(shifts, ["path", "start"]).select("path", "source_file", (F.col("seq") + F.col("shift")).alias("at"), "line")


def _field(header: Column, cells: Column, name: str) -> Column:
    """The cell under a header name, '' if the column or the cell is absent; the last of equal names."""
    back = F.array_position(F.reverse(header), name)
    return F.coalesce(F.when(back > 0, F.get(cells, (F.size(header) - back).cast("int"))), F.lit(""))


def read_vendor_feeds(spark: SparkSession, path: str, schemas: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Records of all vendor files under a directory, mapped by each file's own header.

    ``source_row`` is 1 for the first data row; an empty interior line is a record; a file with
    a header alone has none. The file's schema is the ``schema_name`` cell of its first data
    row. If that cannot be found, or ``schemas`` does not know it, ``strict`` fails the read and
    otherwise the file has no records (``rejected_feeds`` lists it).
    """
    lines = read_numbered_lines(spark, path)
    files = _resolved(lines)
    if schemas is not None:
        known = schemas.select(F.col("schema_name").alias("_known")).distinct()
        files = files.join(known, F.col("file_schema") == F.col("_known"), "left").withColumn("file_schema", F.when(F.col("_known").isNotNull(), F.col("file_schema"))).drop("_known")
    known_schema = F.col("file_schema").isNotNull()
    if strict:  # asked of every line, the header too
        known_schema = known_schema | F.raise_error(F.concat(F.lit("no known schema_name in the first row of "), F.col("source_file"))).cast("boolean")
    read = lines.join(files.drop("source_file"), "path").where(F.when(known_schema, F.col("at") > 0).otherwise(False))
    rows = read.select("source_file", "header", "at", "line")
    cells = rows.withColumn("cells", F.split("line", ",", -1))
    missing = F.size(F.array_except(F.array(*map(F.lit, FEED_REQUIRED)), F.col("header"))) > 0
    own = {
        "source_row": F.col("at"),
        "declared_column_count": F.lit(len(FEED_COLUMNS)),
        "actual_column_count": F.size("header"),
        "missing_required_column": missing,
        "source_file": F.col("source_file"),
    }
    return cells.select(*[own.get(f.name, _field(F.col("header"), F.col("cells"), f.name)).cast(f.dataType).alias(f.name) for f in VENDOR_RECORD.fields])


def _resolved(lines: DataFrame) -> DataFrame:
    """(path, source_file, header, file_schema) of each file that has a line."""
    line = lambda k: F.max(F.when(F.col("at") == k, F.col("line")))
    heads = lines.where("at < 2").groupBy("path", "source_file").agg(line(0).alias("names"), line(1).alias("cells"))
    with_header = heads.select("path", "source_file", F.split("names", ",", -1).alias("header"), F.split("cells", ",", -1).alias("first"))
    own = F.when(F.col("first").isNotNull() & F.array_contains("header", "schema_name"), F.nullif(_field(F.col("header"), F.col("first"), "schema_name"), F.lit("")))
    return with_header.select("path", "source_file", "header", own.alias("file_schema"))


def rejected_feeds(spark: SparkSession, path: str, schemas: DataFrame | None = None) -> DataFrame:
    """Files whose schema cannot be resolved."""
    files = _resolved(read_numbered_lines(spark, path)).select("source_file", "file_schema")
    lost = files.where(F.col("file_schema").isNull())
    if schemas is not None:
        lost = lost.unionByName(files.where(F.col("file_schema").isNotNull()).join(schemas.select(F.col("schema_name").alias("file_schema")), "file_schema", "left_anti").select(*lost.columns))
    return lost.select("source_file", "file_schema")


def _quoted_cells(line: Column) -> Column:
    """The cells of a CSV line, of which some may be in double quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def read_daily_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of the daily files, with quoted fields, and a 0-based ``source_row``.

    The schema's name is the file's without its delivery number. Values keep '' apart from null
    as texts; ``typed_daily_records`` makes numbers of them.
    """
    files = read_whole_files(spark, path, f"{schema}_*.csv" if schema else "*.csv").where(F.size("lines") > 0)
    rows = files.select("source_file", _quoted_cells(F.element_at("lines", 1)).alias("header"), F.posexplode(F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: x != "")).alias("source_row", "line"))
    named = rows.withColumn("cells", _quoted_cells(F.col("line")))
    name = F.regexp_extract("source_file", r"^(.*)_[^_]*\.csv\z", 1)
    return named.select(*[_field(F.col("header"), F.col("cells"), c).alias(c) for c in DAILY_COLUMNS], (F.lit(schema) if schema else name).alias("schema"), "source_file", "source_row")


def daily_manifest(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """(schema, file_name, row_count) of every file, empty ones too."""
    listed = read_whole_files(spark, path).select("source_file", F.regexp_extract("source_file", r"^(.*)_[^_]*\.csv\z", 1).alias("schema"))
    counts = records.groupBy("schema", "source_file").agg(F.count("*").alias("n"))
    return listed.join(counts, ["schema", "source_file"], "left").select("schema", F.col("source_file").alias("file_name"), F.coalesce("n", F.lit(0)).alias("row_count"))


def typed_daily_records(landed: DataFrame, schemas: DataFrame) -> DataFrame:
    """Daily records with numbers and their schema's attributes. '' is no number but null; another
    text that is none fails the run."""
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("double")
    joined = landed.withColumns({"value1": number("value1"), "value2": number("value2")}).join(schemas, "schema")
    return joined.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DAILY_RECORD.fields])


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    """All vintages of feed records, restated ones with the ones they restate."""
    own = [T.StructField("delivery_id", T.StringType()), T.StructField("delivered_at", T.TimestampType())]
    return spark.read.schema(T.StructType([*VENDOR_RECORD.fields, *own])).parquet(path)


def latest_vintages(vintages: DataFrame) -> DataFrame:
    """Of each source file the records of its last delivery only: the one that came last, of equal times that with the larger id."""
    last = vintages.groupBy("source_file").agg(F.max(F.struct("delivered_at", "delivery_id"))["delivery_id"].alias("delivery_id"))
    return vintages.join(last, ["source_file", "delivery_id"], "left_semi")


def read_json_vintages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("schema string, as_of_date string, delivery_id string, payload map<string,string>").json(path)


def load_vintages(tables: dict[str, DataFrame], recorded_at: Column) -> DataFrame:
    """Master, pricing and position rows as vintages (key, recorded_at, seq, payload) of one load."""
    keys = {
        "security_master": F.concat_ws("|", F.lit("SM"), "instrument_id"),
        "pricing": F.concat_ws("|", F.lit("PRICE"), "instrument_id", "price_date"),
        "positions": F.concat_ws("|", F.lit("POS"), "fund_id", "instrument_id", "position_date"),
    }
    parts = []
    for name, key in keys.items():
        df = tables[name]
        payload = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])
        parts.append(df.select(key.alias("key"), recorded_at.alias("recorded_at"), F.col("source_row").cast("bigint").alias("seq"), payload.alias("payload")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
