import random
from collections import Counter

from pyspark.sql import functions as F

from gatewright.llm import sharding

from .helpers import collected, frame, odd_rows


def rows_():
    hot = [(None, "same text", "en", "hot", 0)] * 300  # repeated rows and null ids
    return odd_rows() + hot + [(k, f"text {k} " * (k % 9), "en", "s", k) for k in range(20, 500)]


def test_all_rows_once_and_even(spark):
    df = frame(spark, rows_(), extra=True)
    for bucket_bytes in (1 << 20, 500):
        out = sharding.external_shuffle(df, n_shards=7, bucket_bytes=bucket_bytes)
        assert collected(out.select("doc_id", "text", "source", "label")) == collected(df.select("doc_id", "text", "source", "label"))
        assert sorted(out.columns) == sorted(df.columns)
        places = [(r["shard"], r["slot"]) for r in out.collect()]
        counts = Counter(s for s, _ in places)
        assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
        for s in counts:
            assert sorted(p for x, p in places if x == s) == list(range(counts[s]))


def test_order_is_mixed_and_depends_on_the_seed(spark):
    df = frame(spark, [(k, f"t{k}", "en", "s", 0) for k in range(400)])
    order = lambda seed: [r["doc_id"] for r in sharding.external_shuffle(df, n_shards=1, seed=seed).orderBy("slot").collect()]
    a, b = order(1), order(2)
    assert sorted(a) == list(range(400)) and a != b
    assert sum(x + 1 == y for x, y in zip(a, a[1:])) < 12


def test_written_shards(spark, tmp_path):
    out = sharding.external_shuffle(frame(spark, rows_()), n_shards=3)
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows_())
    assert len(list((tmp_path / "shards").glob("shard=*"))) == 3


def test_empty_table(spark):
    assert sharding.external_shuffle(frame(spark, []), n_shards=3).collect() == []


def _ordered(df, **options):
    out = sharding.external_shuffle(df, n_shards=5, **options)
    place = F.col("slot") * 5 + F.col("shard")
    return [(r["doc_id"], r["text"]) for r in out.orderBy(place).select("doc_id", "text").collect()]


def test_the_seed_alone_gives_the_order(spark):
    rows = rows_()
    df = frame(spark, rows)
    whole = _ordered(df, bucket_bytes=2000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        random.Random(5).shuffle(rows)
        assert _ordered(frame(spark, rows).repartition(6), bucket_bytes=2000) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert _ordered(df, bucket_bytes=2000, seed=43) != whole


def _fisher_yates(n: int, bits: random.Random) -> list[int]:
    """The permutation of ``shuffle``: place i is exchanged with one of 0 to i, drawn by a Mersenne twister."""
    out = list(range(n))
    for i in range(n):
        m = i + 1
        while True:
            x = bits.getrandbits(31)
            if m & -m == m:
                k = m * x >> 31
                break
            k = x % m
            if x - k + m - 1 < 1 << 31:
                break
        out[i], out[k] = out[k], out[i]
    return out


def test_buckets_are_shuffled_by_fisher_yates(spark):
    rows, seed, bucket_bytes = [(k, f"text {k} " * (k % 9), "en", "s", k) for k in range(300)], 42, 2000
    df = frame(spark, rows)
    n_buckets = -(-sum(len(r[1]) + 8 for r in rows) // bucket_bytes)
    a, b = (F.xxhash64(F.lit(seed), F.lit(x), *df.columns) for x in ("a", "b"))
    draw = F.xxhash64(a, b, F.lit(0).cast("long"))
    bucket = F.pmod(draw, F.lit(n_buckets)).cast("long")
    drawn = df.select("doc_id", draw.alias("draw"), bucket.alias("bucket"), F.pmod(F.hash(bucket), F.lit(n_buckets)).alias("task")).collect()
    want = {}
    for task in range(n_buckets):
        bits = random.Random((seed + task) << 32)  # the twister is seeded by the high and the low half
        for own in sorted({r["bucket"] for r in drawn if r["task"] == task}):
            held = sorted((r["draw"], r["doc_id"]) for r in drawn if r["bucket"] == own)
            want[own] = [held[i][1] for i in _fisher_yates(len(held), bits)]
    assert [i for i, _ in _ordered(df, bucket_bytes=bucket_bytes, seed=seed)] == [i for x in sorted(want) for i in want[x]]


def test_maps_and_very_long_texts(spark):
    df = spark.createDataFrame([(1, "x " * 400000, {"a": "b"}), (1, "x " * 400000, {"a": "b"}), (2, None, None)], "doc_id long, text string, more map<string,string>")
    out = sharding.external_shuffle(df, n_shards=2, bucket_bytes=1000).collect()
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in out) == [(1, 800000), (1, 800000), (2, 0)]


def test_files_of_a_shard_are_in_slot_order(spark, tmp_path):
    out = sharding.external_shuffle(frame(spark, rows_()), n_shards=2)
    sharding.write_shards(out, str(tmp_path / "ordered"), rows_in_file=100)
    for shard in (0, 1):
        files = sorted((tmp_path / "ordered" / f"shard={shard}").glob("*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert slots == list(range(len(slots))) and len(files) > 1
