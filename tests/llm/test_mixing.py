import random

import pytest

from gatewright.llm import mixing

from .helpers import collected, frame, odd_rows, sentence

TARGETS = {"clean": 0.7, "junk": 0.1, "toxic": 0.2}


def corpus():
    rng = random.Random(14)
    rows, labels = odd_rows(), []
    for k in range(900):
        kind = ("clean", "clean", "junk", "toxic", "clean")[k % 5]
        words = sentence(rng, rng.randrange(20, 200)).split()
        if kind == "junk":
            words = [w + "***" for w in words]
        if kind == "toxic":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["nasty", "awful", "vile"])
        rows.append((2000 + k, " ".join(words), "en", "hot" if k % 3 == 0 else f"s{k}", 0))
        if k % 2:
            labels.append((2000 + k, kind))
    return rows, [*labels, (None, "clean"), (2001, None), (9, "other"), (12345678, "junk")]


def test_expected_tokens_match_the_targets(spark):
    rows, labels = corpus()
    mixture = mixing.fit_mixture(frame(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, domain string"), TARGETS)
    out = mixing.document_rates(mixture).collect()
    assert len(out) == len(rows)
    total = sum(r["n_tokens"] for r in out)
    for d, share in TARGETS.items():
        got = sum(r["n_tokens"] * r[f"p_{d}"] * r["rate"] for r in out)
        assert got == pytest.approx(share * total, rel=1e-3)
    assert all(r["rate"] >= 0 and sum(r[f"p_{d}"] for d in TARGETS) == pytest.approx(1) for r in out)


def test_posteriors_find_the_domains(spark):
    rows, labels = corpus()
    out = mixing.document_rates(mixing.fit_mixture(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), TARGETS)).collect()
    held_out = [r for r in out if r["doc_id"] and r["doc_id"] >= 2000 and r["doc_id"] % 2 == 0]
    right = sum(max(TARGETS, key=lambda d: r[f"p_{d}"]) == ("clean", "clean", "junk", "toxic", "clean")[(r["doc_id"] - 2000) % 5] for r in held_out)
    assert right / len(held_out) > 0.97


def test_rates_equal_those_of_plain_projected_gradient(spark):
    rows, labels = corpus()
    mixture = mixing.fit_mixture(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), TARGETS)
    cells = [(r["tokens"], list(r["p"]), r["rate"]) for r in mixture.rates.collect()]
    total = sum(c[0] for c in cells)
    t = [TARGETS[d] * total for d in sorted(TARGETS)]
    gram = [[sum(n * p[i] * p[j] for n, p, _ in cells) / (t[i] * t[j]) ** 0.5 for j in range(3)] for i in range(3)]
    largest = max(sum(abs(x) for x in line) for line in gram)
    rate, ahead, inertia = [1.0] * len(cells), [1.0] * len(cells), 1.0
    mass = lambda r: [sum(n * p[i] * x for (n, p, _), x in zip(cells, r)) for i in range(3)]
    for _ in range(100):
        if max(abs(m - u) / u for m, u in zip(mass(rate), t)) < 1e-3:
            break
        e = [(m - u) / u / largest for m, u in zip(mass(ahead), t)]
        new = [min(max(0.0, y - sum(p[i] * e[i] for i in range(3))), 16.0) for (_, p, _), y in zip(cells, ahead)]
        turn = sum(n * (y - x) * (x - r) for (n, _, _), y, x, r in zip(cells, ahead, new, rate))
        grown = 1.0 if turn > 0 else (1 + (1 + 4 * inertia * inertia) ** 0.5) / 2
        beta = 0.0 if turn > 0 else (inertia - 1) / grown
        ahead, rate, inertia = [x + beta * (x - r) for x, r in zip(new, rate)], new, grown
    assert [c[2] for c in cells] == pytest.approx(rate, abs=1e-4)


def test_mixture_keeps_clean_rows_and_all_columns(spark):
    rows, labels = corpus()
    df = frame(spark, rows, extra=True)
    out = mixing.mix(df, spark.createDataFrame(labels, "doc_id long, domain string"), {"clean": 0.97, "junk": 0.01, "toxic": 0.02}, keep_domain="clean")
    assert out.columns == df.columns
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    kind = lambda i: ("clean", "clean", "junk", "toxic", "clean")[(i - 2000) % 5]
    clean = [r[0] for r in rows if r[0] and r[0] >= 2000 and kind(r[0]) == "clean"]
    junk = [r[0] for r in rows if r[0] and r[0] >= 2000 and kind(r[0]) == "junk"]
    assert sum(i in ids for i in clean) >= 0.99 * len(clean)
    assert sum(i in ids for i in junk) < 0.5 * len(junk)
    assert {r[1] for r in collected(out.select("doc_id", "text"))} <= {r[1] for r in rows}


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.document_rates(mixing.fit_mixture(frame(spark, odd_rows()), none, TARGETS)).collect()
    assert len(out) == len(odd_rows()) and all(r["p_junk"] == pytest.approx(1 / 3) for r in out)
    assert mixing.document_rates(mixing.fit_mixture(frame(spark, []), none, TARGETS)).collect() == []
    assert mixing.mix(frame(spark, []), none, TARGETS).collect() == []


def test_thinned_domains_are_never_raised(spark, caplog):
    rows, labels = corpus()
    rows = [r for r in rows if not (r[0] and r[0] >= 2000 and (r[0] - 2000) % 5 == 2 and r[0] % 20)]  # little junk is left
    domains = spark.createDataFrame(labels, "doc_id long, domain string")
    raised = {"clean": 0.5, "junk": 0.3, "toxic": 0.2}
    mixture = mixing.fit_mixture(frame(spark, rows), domains, raised, thin=("junk", "toxic"), keep_domain="clean", max_rate=2.0)
    assert mixture.before["junk"] < 0.3 and mixture.goal["junk"] == pytest.approx(mixing.THIN * mixture.before["junk"])
    assert sum(mixture.goal.values()) == pytest.approx(1)
    out = mixing.document_rates(mixture).collect()
    total = sum(r["n_tokens"] for r in out)
    for d in raised:
        assert mixture.reached[d] == pytest.approx(sum(r["n_tokens"] * r[f"p_{d}"] * r["rate"] for r in out) / total)
    assert mixture.reached["junk"] < mixture.before["junk"]
    strict = mixing.fit_mixture(frame(spark, rows), domains, {"clean": 0.2, "junk": 0.01, "toxic": 0.79}, keep_domain="clean", max_rate=1.0)
    assert strict.unmet() and "are not reached" in caplog.text  # clean cells cannot fall below one


def test_the_stage_lowers_junk():
    import corpus_pipeline
    from gatewright.llm import queries

    called = {}
    real, mixing.mix = mixing.mix, lambda docs, domains, targets, **options: called.update(targets=targets, **options)
    table, queries.table = queries.table, lambda *a: None
    of, queries.label_domains = queries.label_domains, lambda x: x
    try:
        corpus_pipeline.mixing_stage(None, None, "")
    finally:
        mixing.mix, queries.table, queries.label_domains = real, table, of
    assert called["targets"]["junk"] <= 0.03 and set(called["thin"]) == {"junk", "toxic"}
