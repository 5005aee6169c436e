import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewright.llm import kernels, toxicity

from .helpers import PLAIN, frame, lower, odd_rows, sentence

BAD = ["nasty", "awful", "vile"]


def corpus():
    rng = random.Random(19)
    rows, labels = odd_rows(), []
    for k in range(700):
        parts = [sentence(rng, rng.randrange(4, 15)) for _ in range(rng.randrange(2, 9))]
        if k % 6 == 0:
            parts[rng.randrange(len(parts))] += " " + rng.choice(BAD).upper() + " thing"
        rows.append((5000 + k, ". ".join(parts) + ".", "en", "s", 0))
        labels.append((5000 + k, 1, int(k % 6 == 0)))
    return rows, [*labels, (None, 1, 1), (5001, 1, None), (5, 1, 0), (987654, 1, 1)]


def fitted(spark):
    rows, labels = corpus()
    model = toxicity.fit_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), train=F.col("doc_id") % 3 != 0)
    return rows, model


def test_held_out_documents_and_their_sentences(spark):
    rows, model = fitted(spark)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, rows, extra=True), model).collect()}
    text = {r[0]: r[1] for r in rows}
    held = [i for i in text if i and i >= 5000 and i % 3 == 0]
    right = sum((out[i]["score"] >= 0.5) == ((i - 5000) % 6 == 0) for i in held)
    assert right / len(held) > 0.98
    for i in held:
        if (i - 5000) % 6 == 0 and out[i]["score"] >= 0.5:
            spans = [text[i][s["start"] : s["end"]] for s in out[i]["offending"]]
            assert any(any(b in lower(s) for b in BAD) for s in spans)
            assert all(s["p"] >= 0.5 for s in out[i]["offending"])


def features_of(word):
    yield kernels.word_hash(word)
    for k in toxicity.STEMS:
        if len(word) > k:
            yield int(kernels.mix(np.array([kernels.word_hash(word[:k])], np.uint64) + np.uint64(k))[0])


def test_scores_are_noisy_or_over_sentences(spark):
    rows, model = fitted(spark)
    weight = {int(f): w for f, w in zip(model.features, model.weights)}
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    import re

    for r in rows[:60]:
        clean = 1.0
        for s in re.split(r"(?<=[.!?\n])", r[1] or "") or [""]:
            if s == "" and (r[1] or ""):
                continue
            found = {f for w in PLAIN.findall(lower(s)) for f in features_of(w.encode())}
            z = model.bias + sum(weight.get(h, 0.0) for h in found)
            clean *= 1 - 1 / (1 + np.exp(-z))
        if r[0] is not None:
            assert out[r[0]] == pytest.approx(1 - clean, abs=1e-6)


def test_cut_texts_have_the_same_score(spark, monkeypatch):
    rows, model = fitted(spark)
    df = frame(spark, rows)
    batches = pa.table({"id": [r[0] or -1 for r in rows], "text": [r[1] for r in rows]}).to_batches()
    whole = {r["doc_id"]: (r["score"], [tuple(s) for s in r["offending"]]) for r in toxicity.score_toxicity(df, model).collect()}
    captured = {}

    class Capture:
        sparkSession = df.sparkSession

        def select(self, *_):
            return self

        schema = {"id": type("f", (), {"dataType": df.schema["doc_id"].dataType})}

        def mapInArrow(self, run, schema):
            captured["run"] = run
            return self

        def withColumnRenamed(self, *_):
            return self

    toxicity.score_toxicity(Capture(), model)
    monkeypatch.setattr(toxicity, "pieces", lambda c, separators: kernels.pieces(c, 300, separators))
    for b in captured["run"](iter(batches)):
        for i, score, spans in zip(*[c.to_pylist() for c in b.columns]):
            if i in whole and i != 5:
                assert score == pytest.approx(whole[i][0], abs=1e-9)
                assert [(s["start"], s["end"]) for s in spans] == [s[:2] for s in whole[i][1]]


def test_one_class_or_no_labels(spark):
    rows, _ = corpus()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame(spark, rows), none)
    out = toxicity.score_toxicity(frame(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] < 0.5 for r in out)
    assert toxicity.score_toxicity(frame(spark, []), model).collect() == []
