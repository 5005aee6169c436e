import random

import numpy as np
import pyarrow as pa

from gatewright.llm import decontam, kernels

from .helpers import PLAIN, collected, frame, lower, odd_rows, sentence


def brute(text, items):
    windows = {}
    for i, t in items:
        w = PLAIN.findall(lower(t))
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    w = PLAIN.findall(lower(text))
    hit, found = set(), set()
    for size in {len(k) for k in windows}:
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            if k in windows:
                hit |= set(range(a, a + size))
                found |= windows[k]
    return len(w), len(hit), sorted(found)


def planted():
    rng = random.Random(4)
    items = [(i, sentence(rng, n, 80)) for i, n in enumerate([5, 13, 14, 30, 40, 1, 20])] + [(9, None), (10, ""), (11, "..!"), (3, sentence(rng, 15, 80)), (None, sentence(rng, 20, 80))]
    rows = odd_rows()
    for k in range(40):
        words = sentence(rng, 200, 80).split()
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").upper().split()
            at = rng.randrange(180)
            cut = t[: rng.randrange(len(t) + 1)]
            words[at : at + len(cut)] = cut
        rows.append((200 + k, "; ".join(words), "en", "s", 0))
    rows.append((300, items[1][1] + " " + items[1][1], "en", "s", 0))
    return rows, items


def test_hits_match_brute_force(spark):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(i, t) for i, t in items if i is not None]
    want = sorted(((r[0], *brute(r[1], named)) for r in rows), key=repr)
    for block_bytes in (1 << 20, 400):  # one block, and several
        got = decontam.contamination(frame(spark, rows, extra=True), bench, block_bytes=block_bytes)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr) == want
    assert any(w[2] for w in want)


def test_spans_cover_the_hit_words(spark):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.contamination(frame(spark, rows), bench).collect():
        assert sum(s["after"] - s["first"] for s in r["spans"]) == r["n_hit"]


def test_cut_texts_keep_their_windows(monkeypatch):
    rows, items = planted()
    items = [(str(i), t) for i, t in items if i is not None]
    of = decontam.item_windows(items)
    index = decontam.build_index(of, np.arange(len(of.vocab)))
    texts = pa.array([r[1] for r in rows])
    whole = decontam.scan_column(index, texts)
    monkeypatch.setattr(decontam, "pieces", lambda c, separators: kernels.pieces(c, 50, separators))
    assert decontam.scan_column(index, texts) == whole


def test_clean_rows_stay_whole(spark):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows, extra=True)
    named = [(i, t) for i, t in items if i is not None]
    want = []
    for r in rows:
        n, hit, _ = brute(r[1], named)
        if not (hit and 20 * hit >= n):
            want.append((r[0], r[1]))
    for block_bytes in (4 << 20, 400):  # one block, and several
        kept = decontam.drop_contaminated(df, bench, block_bytes=block_bytes)
        assert kept.columns == df.columns
        assert collected(kept.select("doc_id", "text")) == sorted(want, key=repr)


def test_empty_tables(spark):
    rows, items = planted()
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontam.contamination(frame(spark, rows), none).collect()} == {0}
    assert decontam.contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
