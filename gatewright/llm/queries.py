"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, license_scan, lm, mixing, oracle, quality, sharding, simhash, token_counts, toxicity
from .scratch import bucket_of


#: Where this package stands on the driver.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a directory. Python workers on the driver's machine get the package's place, in
    whatever folder the driver runs; on a cluster the package is installed or sent along."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{paths}:{ROOT}".strip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shares of the expected tokens of all documents: junk and toxic text are thinned, the rest takes their place.
MIX_TARGETS = {"clean": 0.95, "junk": 0.03, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """The domain of each labelled document: junk, toxic or clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixture = mixing.fit_mixture(docs, label_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)
    return mixing.document_rates(mixture)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    places = F.transform("phrases", lambda x: x["at"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, more = F.transform("phrases", lambda x: x["label"]), F.transform("hits", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("hits", lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.size("hits").cast("long").alias("n_blocks"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SHARDS = 24


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=SHARDS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = bucket_of(F.col("doc_id"), 7)
    found = lm.score_corpus(docs, (fold >= 0) & (fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = bucket_of(F.col("doc_id"), 3)
    model = langid.fit_ppm(docs.where(fold.isin(0, 2)), sample_col=F.col("doc_id"))
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), byte_bpe_path)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = bucket_of(F.col("doc_id"), 5)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), train=fold > 0)
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), decontam.read_benchmark(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_license_scan": op2_license_scan,
        "op3_quality_rules": op3_quality_rules,
        "op4_sharding": op4_sharding,
        "op5_simhash": op5_simhash,
        "op6_lm_scores": op6_lm_scores,
        "op7_language_id": op7_language_id,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express: the others have tests against brute force or held-out labels."""
    return oracle.oracle_sql()
