import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatewright.llm import kernels, lm

from .helpers import WHITE, frame, lower, odd_rows, sentence


def rows_():
    rng = random.Random(6)
    rows = odd_rows()
    for k in range(60):
        rows.append((400 + k, sentence(rng, rng.randrange(5, 120), 60) + (" The End" if k % 3 else " x%d" % k), "en", "s", 0))
    return rows


def test_baseline_is_exact_and_model_is_a_probability(spark, monkeypatch):
    rows = rows_()
    train = [r for r in rows if r[0] and r[0] % 2]
    c = Counter(w for r in train for w in [*WHITE.findall(lower(r[1])), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = [*WHITE.findall(lower(r[1])), None]
        want.append((r[0], len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    for asked_bytes in (16 << 20, 64):  # 16 ranges, and more ranges than n-grams in a chunk
        monkeypatch.setattr(lm, "ASKED_BYTES", asked_bytes)
        got = lm.score_corpus(frame(spark, rows, extra=True), F.col("doc_id") % 2 != 0).collect()
        assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)


def test_runs_of_ranges_hold_all_hashes():
    h = np.sort(np.random.default_rng(4).integers(0, 1 << 64, 500, np.uint64))
    for top, ranges in ((64, 16), (64, 100000), (48, 7)):
        own = h >> np.uint64(64 - top)
        runs = list(lm.range_runs(own, top, ranges))
        assert [a for _, a, _ in runs] == [0, *[b for _, _, b in runs[:-1]]] and runs[-1][2] == len(own)
        parts = [p for p, _, _ in runs]
        assert parts == sorted(set(parts)) and max(parts) < ranges and len(runs) <= len(own)
    assert list(lm.range_runs(h[:0], 64, 5)) == []


def test_filter_holds_levels():
    rng = np.random.default_rng(2)
    h, c = rng.integers(0, 1 << 63, 3000, np.int64).view(np.uint64), rng.geometric(0.05, 3000)
    for kind in (1, 2):
        f = lm.filter_of(kind, h, c)
        assert (f.levels(kind, h) >= lm.level_of(c)).all()
        assert (f.levels(kind, h) == lm.level_of(c)).mean() > 0.9
        unseen = rng.integers(0, 1 << 63, 20000, np.int64).view(np.uint64)
        assert (f.levels(kind, unseen) > 0).mean() < 2 / 2**lm.HASHES  # the stated rate of false answers, twice over


def test_levels_and_their_counts():
    c = np.arange(1, 5000)
    middle = lm.LEVEL_COUNTS[lm.level_of(c)]
    assert (np.abs(np.log(middle / c)) <= math.log(lm.BASE)).all()
    assert lm.LEVEL_COUNTS[1] == 1


def test_packing_is_lossless():
    h = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))
    c = np.arange(1, len(h) + 1)
    a, b = lm.unpack(lm.pack(h, c))
    assert (a == h).all() and (b == c).all()


def test_pieces_do_not_change_tokens(monkeypatch):
    texts = pa.array([r[1] for r in rows_()])
    join = lambda: [np.concatenate([getattr(t, k) for t in lm.token_pieces(texts)]).tolist() for k in ("h", "before", "row")]
    whole = join()
    monkeypatch.setattr(lm, "pieces", lambda c, separators: kernels.pieces(c, 40, separators))
    assert join() == whole


def test_corpus_scores_come_from_every_ngram(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 200)
    rows = [(-7, " ".join(f"only{k} once{k}" for k in range(300)), "en", "s", 0), *rows_()]
    train = [r for r in rows if r[0] and r[0] % 2]
    got = lm.score_corpus(frame(spark, rows, extra=True), F.col("doc_id") % 2 != 0).collect()
    tokens = lambda r: [None, *WHITE.findall(lower(r[1])), None]
    uni, bi = Counter(w for r in train for w in tokens(r)[1:]), Counter(p for r in train for p in zip(tokens(r), tokens(r)[1:]))
    n, v = sum(uni.values()), len(uni)
    level = lambda c: float(lm.LEVEL_COUNTS[lm.level_of(np.array([c]))[0]]) if c else 0.0
    want = []
    for r in rows:
        t = tokens(r)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t[1:])
        score = sum(math.log10(lm.WEIGHT * min(level(bi[a, b]) / max(level(uni[a]), 1), 1) + (1 - lm.WEIGHT) * (level(uni[b]) + 1) / (n + v + 1)) for a, b in zip(t, t[1:]))
        want.append((r[0], len(t) - 1, sum(uni[w] > 0 for w in t[1:]), round(base, 6), score))
    key = lambda x: (repr(x[:4]), x[4])
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["score"]) for r in got), key=key)
    want.sort(key=key)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    close = [abs(a[4] - b[4]) <= 0.02 * abs(b[4]) for a, b in zip(have, want)]  # filters err on the side of more
    assert sum(close) >= 0.95 * len(close)
    assert close[next(i for i, x in enumerate(want) if x[0] == -7)]  # all its bigrams were seen once
    assert {r["train_tokens"] for r in got} == {n}


def test_filters_grow_with_their_ngrams():
    h = np.arange(1, 400001, dtype=np.uint64) * np.uint64(7919)
    f = lm.filter_of(2, h, np.ones(len(h), np.int64))
    assert f.bits.size * 8 >= len(h) * lm.HASHES
    assert (f.levels(2, h) >= 1).all() and (f.levels(2, h) == 1).mean() > 0.9


def test_corpus_without_training_rows_or_rows(spark):
    got = lm.score_corpus(frame(spark, odd_rows()), F.lit(False)).collect()
    assert len(got) == len(odd_rows()) and {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    assert lm.score_corpus(frame(spark, []), F.lit(True)).collect() == []
