import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gatewright.llm import kernels, simhash

from .helpers import WHITE, collected, frame, lower, odd_rows, sentence


def brute_fp(text):
    w = WHITE.findall(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, distance=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(i)
    out = {}
    for group in members.values():
        known = [ids[i] for i in group if ids[i] is not None]
        for i in group:
            out[i] = min(known) if known else None
    return [out[i] for i in range(len(ids))]


def near_rows(seed=3):
    rng = random.Random(seed)
    rows = odd_rows()
    for k in range(12):
        words = sentence(rng, 300).split()
        rows.append((100 + 10 * k, " ".join(words), "en", "s", 0))
        for j in range(1, 4):
            words[rng.randrange(300)] = "changed"
            rows.append((100 + 10 * k + j, " ".join(words), "en", "s", 0))
    return rows


def test_fingerprints_and_groups_match_brute_force(spark):
    rows = near_rows()
    got = simhash.near_duplicates(frame(spark, rows, extra=True)).collect()
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_groups([r[0] for r in rows], fps)), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want
    assert len({w[2] for w in want}) < len(rows) - 12


def test_long_texts_are_cut_without_a_trace(spark, monkeypatch):
    import pyarrow as pa

    texts = [sentence(random.Random(5), 500), None, "x" * 300, "a b", ""]
    whole = simhash.fingerprint_column(pa.array(texts))
    for size in (16, 64, 200):
        monkeypatch.setattr(simhash, "pieces", lambda c, separators, size=size: kernels.pieces(c, size, separators))
        assert (simhash.fingerprint_column(pa.array(texts)) == whole).all()
    assert [int(x) % (1 << 64) for x in whole] == [brute_fp(t) for t in texts]


@pytest.mark.parametrize("dense_limit", [2, 40, 8192])
def test_hot_keys_are_linked_without_all_pairs(spark, dense_limit):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:  # a dense ball, and points of their own
        x = centre
        for _ in range(rng.randrange(1, 8)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "id long, fp long")
    got = {r["id"]: r["component_id"] for r in simhash.near_groups(df, dense_limit=dense_limit).collect()}
    assert [got[i] for i in range(len(fps))] == brute_groups(list(range(len(fps))), fps)


def test_every_close_pair_shares_a_table():
    rng = np.random.default_rng(1)
    for _ in range(300):
        flip = 0
        for b in rng.choice(64, 3, replace=False):
            flip |= 1 << int(b)
        assert any(not m & flip for m in simhash.MASKS)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = dict(tuple(r) for r in simhash.components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def shingle_sets(text, width=5):
    w = WHITE.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))}


def similar_groups(rows, least=0.8):
    """For each row the smallest id of its group, groups being what pairs at a similarity of ``least`` join."""
    sets = [shingle_sets(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [smallest[find(i)] for i in range(len(rows))]


def test_keep_one_keeps_all_columns_and_one_of_each_group(spark):
    rows = near_rows()
    df = frame(spark, rows, extra=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert collected(kept.select("doc_id")) == sorted({(g,) for g in similar_groups(rows)}, key=repr)
    assert kept.where(F.col("shard") == 77).count() == kept.count()


@pytest.mark.parametrize("dense_limit", [3, 8192])
def test_near_duplicates_at_four_fifths_are_found(spark, dense_limit):
    """Pairs at 0.8 to 0.9, where recall is least, and others at 0.6 and below, of which none may go."""
    rng, rows = random.Random(21), []
    for k in range(150):
        words = sentence(rng, 300, 5000).split()
        rows.append((10 * k, " ".join(words), "en", "s", 0))
        edits = rng.randrange(3, 7) if k % 2 else rng.randrange(16, 40)
        for i in rng.sample(range(0, 300, 6), edits):
            words[i] = f"new{k}"
        rows.append((10 * k + 1, " ".join(words), "en", "s", 0))
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, rows), dense_limit=dense_limit).select("doc_id").collect()}
    groups = similar_groups(rows)
    copies = [r[0] for r, g in zip(rows, groups) if g != r[0]]
    apart = [r[0] for r, g in zip(rows, similar_groups(rows, 0.7)) if g == r[0]]
    assert len(copies) > 60 and sum(i not in kept for i in copies) >= 0.9 * len(copies)
    assert all(i in kept for i in apart)


def test_signatures_match_brute_force(monkeypatch):
    import pyarrow as pa

    texts = [sentence(random.Random(5), 700), None, "x" * 300, "a b", "", "one two three four", sentence(random.Random(6), 256)]
    top = (1 << 64) - 1

    def finish(x):
        return int(kernels.mix(np.array([x & top], np.uint64))[0])

    def brute(text, width, seed):
        h = [kernels.word_hash(w.encode()) for w in WHITE.findall(lower(text))]
        runs = [h[i : i + width] for i in range(max(len(h) - width + 1, min(len(h), 1)))]
        found = []
        for run in runs:
            x = 0
            for y in run:
                x = finish((x * simhash.SEEDS[0] & top) ^ y)
            found.append(finish(x ^ seed))
        # Bytes are in the machine's order, lowest first; bits of a byte highest first.
        bit = lambda x, b: x >> (8 * (b // 8) + 7 - b % 8) & 1
        return sum(1 << (63 - b) for b in range(64) if 2 * sum(bit(x, b) for x in found) > len(found))

    want = [[brute(t, width, seed) for width in (simhash.BLOCKED, simhash.COMPARED) for seed in simhash.SEEDS] for t in texts]
    for size in (1 << 20, 16, 200):
        monkeypatch.setattr(simhash, "pieces", lambda c, separators, size=size: kernels.pieces(c, size, separators))
        assert [[int(x) % (1 << 64) for x in row] for row in simhash.signature_column(pa.array(texts))] == want


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []


def test_no_table_that_grows_is_broadcast(spark):
    """Small files are planned as broadcasts, however large they are in memory; here all are small."""
    docs = frame(spark, near_rows())
    for found in (simhash.keep_one(docs), simhash.near_duplicates(docs)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    classes = spark.range(64).selectExpr("id AS cid", *[f"0L AS v{i}" for i in range(4)], "array(id) AS keys")
    edges = spark.range(64).selectExpr("id AS u", "id + 1 AS v")
    for found in (simhash.similar_links(classes), simhash._smallest_neighbour(edges)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def links_of(ids, sets):
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    return simhash.set_links(np.array(ids), np.concatenate([sorted(x) for x in sets]), bounds)


def test_set_links_match_brute_force():
    rng = random.Random(4)
    for n in (2, 9, 60):
        base = [rng.getrandbits(40) for _ in range(30)]
        sets = [{x if rng.random() > 0.12 else rng.getrandbits(40) for x in rng.choice((base, base[:5]))} for _ in range(n)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(n):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        u, v = links_of(range(n), sets)
        assert sorted(zip(v.tolist(), u.tolist())) == [(i, find(i)) for i in range(n) if find(i) != i]


@pytest.mark.parametrize("dense_limit", [5, 8192])
def test_no_pair_at_four_fifths_is_left_out(spark, dense_limit):
    """Large groups at 0.75 to 0.85 and pairs within them, repeated lines, and short texts: groups are those of all pairs."""
    rng, rows = random.Random(8), odd_rows()
    for k in range(6):
        base = sentence(rng, 200, 5000).split()
        for j in range(40):  # two such differ from each other in twice as many places as from the base
            words = list(base)
            for i in rng.sample(range(2, 198, 5), rng.randrange(1, 6)):
                words[i] = f"k{k}j{j}i{i}"
            rows.append((1000 * (k + 1) + j, " ".join(words), "en", "s", 0))
    for k in range(60):  # the similarity is that of distinct shingles, however often these occur
        line, words = sentence(rng, 12, 5000), sentence(rng, 120, 5000)
        rows += [(20000 + 2 * k, words + " " + line, "en", "s", 0), (20001 + 2 * k, words + (" " + line) * rng.randrange(5, 40), "en", "s", 0)]
    for k in range(30):
        words = sentence(rng, rng.randrange(5, 16), 5000)
        rows += [(30000 + 2 * k, words, "en", "s", 0), (30001 + 2 * k, words + " more", "en", "s", 0)]
    kept = simhash.keep_one(frame(spark, rows), dense_limit=dense_limit)
    assert collected(kept.select("doc_id")) == sorted({(g,) for g in similar_groups(rows)}, key=repr)
