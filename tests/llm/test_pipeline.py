"""The pipeline and the registered queries over a small directory of tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from gatewright.llm import mixing, quality, queries

from . import test_decontam, test_quality, test_simhash
from .helpers import collected, frame, odd_rows, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    planted, items = test_decontam.planted()
    junk, labels = test_quality.corpus()
    near = [(r[0] + 10000, *r[1:]) for r in test_simhash.near_rows() if r not in planted]
    rows = planted + near + junk[11:900]
    frame(spark, rows).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, items


def test_stages_against_brute_force(spark, directory):
    d, rows, items = directory
    docs = queries.table(spark, d, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "dedup", "decontamination", "mixing", "sharding"]

    good = stages["quality"](spark, docs, d)
    assert good.columns == COLUMNS
    kept = collected(good)
    passing = [r for r in rows if not test_quality.brute(r[1])[-1]]
    assert not Counter(kept) - Counter(map(tuple, passing))
    cut = quality.calibrate(quality.signal_table(docs), queries.table(spark, d, "labels")).collect()
    if not any(v is not None for r in cut for k, v in r.asDict().items() if k.startswith("cut_")):
        assert kept == sorted((tuple(r) for r in passing), key=repr)

    one = stages["dedup"](spark, docs, d)
    groups = test_simhash.similar_groups(rows)
    assert one.columns == COLUMNS and collected(one.select("doc_id")) == sorted({(g,) for g in groups}, key=repr)

    clean = stages["decontamination"](spark, docs, d)
    named = [(i, t) for i, t in items if i is not None]
    want = []
    for r in rows:
        n, hit, _ = test_decontam.brute(r[1], named)
        if not (hit and 20 * hit >= n):
            want.append(tuple(r))
    assert clean.columns == COLUMNS and collected(clean) == sorted(want, key=repr)

    mixed = stages["mixing"](spark, docs, d)
    assert mixed.columns == COLUMNS and set(collected(mixed)) <= {tuple(r) for r in rows}

    dealt = stages["sharding"](spark, docs, d)
    assert dealt.columns == [*COLUMNS, "shard", "slot"]
    assert collected(dealt.select(COLUMNS)) == sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def odd_directory(spark, tmp_path_factory):
    """Nulls, empty and repeated rows, null ids, a very long text, and columns named like the operators' own."""
    d = tmp_path_factory.mktemp("odd")
    rng = random.Random(23)
    rows = [*odd_rows(), (11, sentence(rng, 150000, 90000), "en", "s", 1), *[(20 + k, sentence(rng, 60), "en", "s", 0) for k in range(30)]]
    frame(spark, rows, extra=True).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(20 + k, k % 3 and 1, 0) for k in range(20)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(None, "a"), (1, None), (2, "")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd_directory, name):
    d, rows = odd_directory
    docs, stage = queries.table(spark, d, "documents"), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, d)
    whole = out.collect()
    own = ["shard", "slot"] if name == "sharding" else []
    assert sorted(out.columns) == sorted({*docs.columns, *own})
    texts = [(r["doc_id"], r["text"]) for r in whole]
    assert set(texts) <= {(r[0], r[1]) for r in rows}
    if name == "sharding":
        assert sorted(texts, key=repr) == sorted(((r[0], r[1]) for r in rows), key=repr)
    if name != "mixing":
        assert any(i == 11 for i, _ in texts)  # the long text is clean and has no copy
    assert {r["label"] for r in whole} <= {"q"}
    if name in ("quality", "decontamination"):  # the other stages' operators have this test of their own
        assert stage(spark, docs.limit(0), d).collect() == []


@pytest.mark.parametrize("name", ["op1_mixing", "op2_license_scan", "op3_quality_rules", "op4_sharding"])
def test_native_queries_take_odd_rows(spark, odd_directory, name):
    d, rows = odd_directory
    got = queries.queries()[name](spark, d).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    long = next(r for r in got if r["doc_id"] == 11)
    words = {"op1_mixing": "n_tokens", "op2_license_scan": "n_words", "op3_quality_rules": "n_words"}.get(name)
    assert long[words] == 150000 if words else long["size"] == len(rows[11][1]) + 8


def test_mixing_reaches_its_shares(spark, directory):
    """Expected tokens by domain, of the documents as often as they come out, against what was aimed at."""
    d, rows, _ = directory
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels")
    domains = queries.label_domains(labels)
    options = {"thin": ("junk", "toxic"), "keep_domain": "clean", "max_rate": 2.0}
    fitted = mixing.fit_mixture(docs, domains, queries.MIX_TARGETS, **options)
    by_id = {}
    for r in mixing.document_rates(fitted).collect():
        by_id.setdefault(r["doc_id"], r)
    total = sum(r["n_tokens"] for r in mixing.document_rates(fitted).collect())
    out = [by_id[r["doc_id"]] for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, d).collect()]
    for name in queries.MIX_TARGETS:
        assert fitted.reached[name] <= max(fitted.goal[name], fitted.before[name]) * 1.01 or name == "clean"
        drawn = sum(r["n_tokens"] * r[f"p_{name}"] for r in out) / total
        assert drawn == pytest.approx(fitted.reached[name], abs=0.02)
    assert fitted.goal["junk"] <= 0.5 * fitted.before["junk"] + 1e-9
    clean = [r for r in by_id.values() if r["p_clean"] >= 0.5]
    assert {r["doc_id"] for r in clean} <= {r["doc_id"] for r in out}


def test_run_applies_all_stages_in_order(spark, directory):
    d, rows, _ = directory
    out = corpus_pipeline.run(spark, d)
    assert out.columns == [*COLUMNS, "shard", "slot"]
    assert 0 < out.select("doc_id").distinct().count() < len(rows)
    assert max(Counter(r["shard"] for r in out.collect()).values()) <= out.count() // queries.SHARDS + 1


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_a_row_for_each_document(spark, directory, name):
    d, rows, _ = directory
    out = queries.queries()[name](spark, d)
    got = out.collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    contract = {
        "op2_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
        "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op6_lm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op10_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    }.get(name, "doc_id bigint")
    assert ", ".join(f"{a} {b}" for a, b in out.dtypes).startswith(contract)
