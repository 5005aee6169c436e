"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one gives every record a seeded draw and writes the drawn table to the shared folder. Pass
two scatters it by the draw into buckets that fit in memory, shuffles each bucket by Fisher-Yates
(``shuffle`` of an array of its draws, in order), and lays the buckets end to end. Place p in that
order is slot ``p div shards`` of shard ``p mod shards``, so row counts are at most one apart.

The order is a function of the seed and the rows alone. A draw is a hash of the row's values and,
among rows that are equal in all columns, of its number; the number of buckets and of partitions
comes from the bytes of the texts; a bucket's partition, and so the seed of its shuffle, from its
number. How the input was dealt to partitions, or how many a shuffle has, changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import PREFIX, materialize, unwrap, wrap

BUCKET_BYTES = 16 << 20
#: Buckets share partitions beyond this many.
MAX_PARTITIONS = 20000
#: Buckets whose counts are summed before the sums are.
BUCKETS_AT_ONCE = 4096


def _hashable(row: Column, schema: T.StructType) -> list[Column]:
    """The row's columns, as JSON where a hash does not take them."""
    return [F.to_json(F.struct(row[f.name])) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else row[f.name] for f in schema.fields]


def _numbered(keyed: DataFrame) -> DataFrame | None:
    """(place, k) of all rows of ``keyed`` (a, b, place) that equal another: k from 0 in each group; None if no row does.

    Rows are counted by group and task first, so a group of any size is a few rows a task, and a
    window holds one task's rows of a group at most.
    """
    task = F.shiftright("place", 33).alias("task")
    per = keyed.groupBy("a", "b", task).agg(F.count("*").alias("n"))
    group = Window.partitionBy("a", "b")
    earlier = group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"total": F.sum("n").over(group), "before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    repeated = materialize(per.where("total > 1").select("a", "b", "task", "before"), "shuffle-repeated")
    if repeated.isEmpty():
        return None
    own = keyed.select("a", "b", task, "place").join(repeated, ["a", "b", "task"])
    within = F.row_number().over(Window.partitionBy("a", "b", "task").orderBy("place")) - 1
    return materialize(own.select("place", (F.col("before") + within).alias("k")), "shuffle-numbered")


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, offset) from (bucket, n): sums over runs of buckets, so that no task sees all of them."""
    run = F.floor(F.col("bucket") / BUCKETS_AT_ONCE)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy(run.alias("run")).agg(F.sum("n").alias("n"))
    runs = runs.select(F.col("run").alias("of"), before(Window.orderBy("run")).alias("start"))
    within = counts.select("bucket", run.alias("run"), before(Window.partitionBy(run).orderBy("bucket")).alias("at"))
    return within.join(runs, F.col("run") == F.col("of")).select("bucket", (F.col("start") + F.col("at")).alias("offset"))


def external_shuffle(docs: DataFrame, *, n_shards: int, seed: int = 42, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` with all columns, and ``shard`` (int) and ``slot`` (long, from 0).

    Repeated rows have draws of their own, so they, null ids or one source with most rows spread
    evenly over the buckets. Columns named shard or slot are replaced; a null text has no bytes;
    an empty table gives no rows; very long texts make a bucket as large as they are. Equal rows
    are known by 128 bits of hashes.
    """
    columns = docs.columns
    row = F.col(PREFIX + "row")
    values = _hashable(row, docs.schema)
    size = (F.coalesce(F.octet_length(row[text_col].cast("string")), F.lit(0)) + 8).cast("long").alias("size")
    a, b = (F.xxhash64(F.lit(seed), F.lit(x), *values).alias(x) for x in ("a", "b"))
    hashed = materialize(wrap(docs).select(a, b, F.monotonically_increasing_id().alias("place"), size, row), "shuffle-drawn")
    numbers = _numbered(hashed.select("a", "b", "place"))
    total = hashed.agg(F.sum("size")).collect()[0][0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    numbered = hashed.withColumn("k", F.lit(0).cast("long")) if numbers is None else hashed.join(numbers, "place", "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
    draw = F.xxhash64("a", "b", "k")
    drawn = numbered.select(F.pmod(draw, F.lit(n_buckets)).cast("long").alias("bucket"), F.struct(draw.alias("draw"), F.col("a"), F.col("k")).alias("key"), row)
    offsets = _offsets(drawn.groupBy("bucket").agg(F.count("*").alias("n")))
    dealt = drawn.repartition(min(n_buckets, MAX_PARTITIONS), "bucket")
    filled = dealt.groupBy("bucket").agg(F.collect_list(F.struct("key", row)).alias("rows"))
    keys = F.sort_array(F.transform("rows", lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"))))
    ordered = filled.select("bucket", "rows", keys.alias("keys")).sortWithinPartitions("bucket")
    shuffled = ordered.select("bucket", "rows", F.shuffle(F.col("keys"), F.lit(seed)).alias("keys"))
    whole = shuffled.select("bucket", F.transform("keys", lambda k: F.get("rows", k["i"])[PREFIX + "row"]).alias("rows"))
    placed = whole.join(offsets.hint("shuffle_hash"), "bucket").select("offset", F.posexplode("rows").alias("at", PREFIX + "row"))
    place = F.col("offset") + F.col("at")
    return placed.select(
        row,
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(place / F.lit(n_shards)).cast("long").alias("slot"),
    ).select(*unwrap(columns, ["shard", "slot"]), "shard", "slot")


def write_shards(shuffled: DataFrame, path: str, *, rows_in_file: int = 1 << 20) -> None:
    """Write the output of ``external_shuffle`` as one folder for each shard, its files in slot order.

    Runs of slots go to tasks by range, so a shard's files follow each other and each is sorted.
    """
    n_files = max(1, math.ceil(shuffled.count() / rows_in_file))
    shuffled.repartitionByRange(n_files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
