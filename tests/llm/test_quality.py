import math
import random

import pytest
from pyspark.sql import functions as F

from gatewright.llm import quality

from .helpers import WHITE, collected, frame, odd_rows, sentence


def brute(text):
    text = text or ""
    w = WHITE.findall(text)
    places = {}
    for a in range(len(w) - 4):
        places.setdefault(tuple(w[a : a + 5]), []).append(a)
    covered = {a + k for at in places.values() if len(at) > 1 for a in at for k in range(5)}
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def corpus():
    rng = random.Random(8)
    rows, labels = odd_rows(), []
    for k in range(3000):
        text = sentence(rng, rng.randrange(12, 60))
        bad = k % 5 == 0
        if bad:
            text = " ".join(f"{x}###" for x in text.split())
        elif k % 7 == 0:
            text += " a|b" * rng.randrange(1, 3)
        if k % 11 == 0:
            text += "\n" + " ".join(text.split()[:8]) + "\nsame line\nsame line"
        rows.append((1000 + k, text, "en" if k % 3 else "de", "s", 0))
        labels.append((1000 + k, 0 if bad else 1, 0))
    return rows, [*labels, (1001, 1, None), (None, 1, 0), (1002, None, 0), (999999, 0, 0)]


def test_counts_match_brute_force(spark):
    rows, labels = corpus()
    got = quality.judge(frame(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_certified_cutoffs_reject_junk_and_keep_good_documents(spark):
    rows, labels = corpus()
    df = frame(spark, rows, extra=True)
    kept = quality.keep_good(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), alpha=0.1)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good = [r for r in rows if r[0] and r[0] >= 1000 and (r[0] - 1000) % 5]
    passing = [r for r in good if not brute(r[1])[-1]]
    assert sum(r[0] not in ids for r in passing) <= 0.1 * len(passing)
    junk = [r for r in rows if r[0] and r[0] >= 1000 and (r[0] - 1000) % 5 == 0]
    assert sum(r[0] in ids for r in junk) == 0


def test_cutoffs_are_those_of_the_binomial_bound(spark):
    rows, labels = corpus()
    signals = quality.signal_table(frame(spark, rows))
    cut = {r["stratum"]: r for r in quality.calibrate(signals, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), alpha=0.05).collect()}
    per = {}
    marks = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            marks[i] = min(q, marks.get(i, 1))
    for r in signals.collect():
        if not r["base_failed"] and r["doc_id"] in marks:
            per.setdefault(r["stratum"], []).append((marks[r["doc_id"]], r))
    tests = sum(len(c) for c in quality.RULES.values()) * len(per)
    rate = 0.05 / len(quality.RULES)
    for stratum, found in per.items():
        n = sum(q for q, _ in found)
        for rule, cutoffs in quality.RULES.items():
            best = None
            for c in cutoffs:
                k = sum(q for q, r in found if r[rule] > c)
                caught = sum(1 - q for q, r in found if r[rule] > c)
                p = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
                if p <= 0.05 / tests and caught and (best is None or (caught, c) > best):
                    best = (caught, c)
            assert (cut[stratum][f"cut_{rule}"] if stratum in cut else None) == (best and best[1])


def test_no_stratum_is_left_out(spark):
    rule, n = next(iter(quality.RULES)), 130
    values = [F.lit(0.0).alias(r) for r in quality.RULES if r != rule]
    bad = F.col("id") % n >= 120
    signals = spark.range(70 * n).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / n).cast("string").alias("stratum"), F.lit(False).alias("base_failed"), F.when(bad, 1.0).otherwise(0.0).alias(rule), *values)
    labels = spark.range(70 * n).select(F.col("id").alias("doc_id"), (~bad).cast("int").alias("quality"))
    cut = quality.calibrate(signals, labels, alpha=0.5).collect()
    assert {r["stratum"] for r in cut} == {str(k) for k in range(70)}
    kept = quality.verdicts(signals, quality.calibrate(signals, labels, alpha=0.5)).where("kept").count()
    assert kept == 70 * 120


@pytest.mark.parametrize(("k", "n", "rate"), [(0, 100, 0.01), (3, 50, 0.1), (10, 5000, 0.004), (49, 50, 0.2), (20, 20000, 0.002)])
def test_binomial_tail(spark, k, n, rate):
    got = spark.range(1).select(quality.binomial_at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), rate).alias("p")).first()["p"]
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = odd_rows()
    kept = quality.keep_good(frame(spark, rows), none)
    assert collected(kept.select("doc_id", "text")) == sorted([(r[0], r[1]) for r in rows if not brute(r[1])[-1]], key=repr)
    assert quality.judge(frame(spark, []), none).collect() == []


def test_no_python_in_the_plan(spark):
    rows, labels = corpus()
    signals = quality.signal_table(frame(spark, rows[:20]))
    plan = signals._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonSQLConf", "") and "Arrow" not in plan
