"""Shared scratch space and small helpers that the text operators have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import fresh_path

PREFIX = "__gw_"


#: Paths of the tables that were written and not yet released.
_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs only the reads that it was serving, and several consumers
    read the table instead of computing it again.
    """
    path = fresh_path(df.sparkSession, label)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The tables written so far and not released."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Empty tables that nothing reads any more, through Spark's own writer, whatever store holds them."""
    nothing = spark.range(0)
    for path in paths:
        nothing.write.mode("overwrite").parquet(path)
        _written.remove(path)


def bucket_of(id_col: Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(-1))


#: Draws are below this number, so that shares of far more rows than there can be do not round to zero.
DRAWS = 1 << 62


def draw_of(seed: int, key: Column) -> Column:
    """A seeded draw from 0 to ``DRAWS`` for a key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(DRAWS))


def draw_below(share: float) -> int:
    """What draws are below for about ``share`` of all keys; never zero."""
    return max(1, int(min(1.0, share) * DRAWS))


def drawn(seed: int, key: Column, share: float) -> Column:
    """True for about ``share`` of all keys."""
    return draw_of(seed, key) < F.lit(draw_below(share))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, whatever body does with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wrap(df: DataFrame, name: str = PREFIX + "row") -> DataFrame:
    """All columns of ``df`` in one struct, so that no name of theirs can clash with ours."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def unwrap(columns: list[str], replaced: list[str], name: str = PREFIX + "row") -> list[Column]:
    """The columns that ``wrap`` put away, but for those that the operator's own ones replace."""
    gone = {c.lower() for c in replaced}
    return [F.col(name).getField(c).alias(c) for c in columns if c.lower() not in gone]
