import math
import random

import numpy as np
import pyarrow as pa

from gatewright.llm import kernels, langid

from .helpers import frame, odd_rows

SYLLABLES = {"aa": ["la", "mo", "ti", "ru"], "bb": ["sch", "keit", "ung", "ä"], "cc": ["éau", "oi", "ez", "tre"]}


def text_of(lang, rng, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def train_rows():
    rng = random.Random(16)
    return [(i, text_of(lang, rng), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]


def tree_bits(train, lang, text, min_context=4):
    """Code length of a text by a plain walk down the context tree."""
    counts, seen = {}, set(b" ")
    deep = {}
    for _, t, own, _, _ in train:
        b = b"   " + t.encode()
        seen |= set(b[3:]) | ({32} if t else set())
        for i in range(3, len(b)):
            deep[b[i - 3 : i]] = deep.get(b[i - 3 : i], 0) + 1
            if own == lang:
                for k in range(4):
                    counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                    counts[b[i - k : i]][b[i]] += 1

    def p(context, byte):
        if len(context) == 3 and deep.get(context, 0) < min_context:
            return p(context[1:], byte)
        shorter = (lambda x: p(context[1:], x)) if context else (lambda x: 1 / 256)
        own = counts.get(context)
        if not own:
            return shorter(byte)
        total, distinct = sum(own.values()), len(own)
        left = 1 - sum(shorter(x) for x in own)
        escape = distinct / (total + distinct) if left > 1e-12 else 0
        return (1 - escape) * own[byte] / total if byte in own else escape * shorter(byte) / left

    b = b"   " + text.encode()
    return sum(-math.log2(p(b[i - 3 : i], b[i])) for i in range(3, len(b)))


def test_code_lengths_are_those_of_the_tree(spark):
    train = train_rows()[:24]
    model = langid.fit_ppm(frame(spark, train))
    rng = random.Random(17)
    texts = [text_of("aa", rng, 3), text_of("bb", rng, 3), "xyz Ω!", "a"]
    got = langid.code_lengths(model, pa.array(texts))
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert abs(got[i, k] - tree_bits(train, lang, t)) < 1e-2 * max(1, got[i, k])


def test_probabilities_sum_to_one(spark):
    model = langid.fit_ppm(frame(spark, train_rows()))
    a = model.n_classes
    width = np.ones(a)
    width[-1] = 256 - (a - 1)
    for k in range(len(model.languages)):
        p = np.exp2(-model.bits[:, k].reshape(-1, a)) @ width
        assert np.allclose(p, 1, atol=1e-4)


def test_held_out_accuracy_and_edge_cases(spark):
    model = langid.fit_ppm(frame(spark, train_rows()))
    rng = random.Random(18)
    rows = [(100 + i, text_of(lang, rng, 5), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, rows, extra=True), model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] and 0 <= got[r[0]]["score"] <= 1 for r in rows)
    odd = langid.identify(frame(spark, [*odd_rows(), (77, "123 !?", "en", "s", 0)]), model).collect()
    assert len(odd) == len(odd_rows()) + 1
    for r in odd:
        if r["doc_id"] in (1, 2, 3, 77):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_cut_texts_have_the_same_length(spark, monkeypatch):
    model = langid.fit_ppm(frame(spark, train_rows()))
    texts = pa.array([r[1] for r in train_rows()] + [None, ""])
    whole = langid.code_lengths(model, texts)
    monkeypatch.setattr(langid, "pieces", lambda c: kernels.pieces(c, 37))
    assert np.allclose(langid.code_lengths(model, texts), whole)


def test_nothing_to_learn(spark):
    assert langid.fit_ppm(frame(spark, [])) is None
    assert {r["lang_pred"] for r in langid.identify(frame(spark, odd_rows()), None).collect()} == {"und"}
    assert langid.identify(frame(spark, []), None).collect() == []


def test_every_language_is_learned(spark):
    text = lambda k, rng: "".join(chr(0x4E00 + 64 * k + rng.randrange(20)) for _ in range(60))
    rng = random.Random(18)
    train = [(1000 * k + i, text(k, rng), f"l{k:02d}", "s", 0) for k in range(70) for i in range(3 if k < 64 else 2)]
    model = langid.fit_ppm(frame(spark, train))
    assert model.languages == [f"l{k:02d}" for k in range(70)]
    held_out = [(k, text(k, rng), None, "s", 0) for k in range(70)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, held_out), model).collect()}
    assert got == {k: f"l{k:02d}" for k in range(70)}


def test_several_models_say_what_one_says(spark):
    train = frame(spark, train_rows())
    one, many = langid.fit_ppm(train), langid.fit_ppm(train, model_bytes=1)
    assert isinstance(many, list) and [m().languages for m in many] == [["aa"], ["bb"], ["cc"]]
    rng = random.Random(18)
    rows = [(100 + i, text_of(lang, rng, 4), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 5)]
    docs = frame(spark, [*odd_rows(), *rows], extra=True)
    key = lambda r: (repr(r["doc_id"]), r["lang_pred"], r["score"])
    a, b = (sorted(langid.identify(docs, m).collect(), key=key) for m in (one, many))
    assert [(r["doc_id"], r["lang_pred"]) for r in a] == [(r["doc_id"], r["lang_pred"]) for r in b]
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b], rtol=1e-3)


def test_languages_are_packed_by_size():
    sizes = [("a", 10), ("b", 10), ("c", 500), ("d", 10)]
    bound = 4 * 12 * (144 + 20) * 2
    assert langid.packed_languages(sizes, 10, bound) == [["a", "b"], ["c"], ["d"]]
    assert langid.packed_languages(sizes, 10, 1 << 30) == [["a", "b", "c", "d"]]


def test_a_share_of_very_many_rows_is_not_zero():
    from gatewright.llm.scratch import DRAWS, draw_below

    assert draw_below(2000 / 1e18) > 0 and draw_below(1e-30) == 1 and draw_below(2.0) == DRAWS
