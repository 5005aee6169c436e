"""SimHash near-duplicate groups: fingerprints, pigeonhole blocks, and connected components.

* A fingerprint bit is set if it is set in more than half of the hashes of a text's shingles.
* Equal fingerprints form one class. Classes link at ``distance`` (3) or fewer differing bits.
* The 64 bits are split into six blocks. Two fingerprints that differ in at most three bits
  agree on at least three whole blocks, so they share a key in one of the 20 tables that keep
  three blocks each, about 32 bits.
* The fingerprints of one key are linked by a search that visits each once and gives a star for
  each group, never all pairs. A key with more than ``dense_limit`` different fingerprints is not
  gathered: every fingerprint names the centres within two bits of it (over the key's free bits),
  and those at a centre are linked to the smallest that is within one bit. That finds all pairs
  within three bits by rows in proportion to the fingerprints, with at most 562 at a centre: a key
  leaves 31 to 33 bits free, and 1 + 33 + 33 * 32 / 2 fingerprints lie within two of them.
* Stars are merged to components by alternating large-star and small-star steps on salted keys,
  each written to the shared folder.

Three bits of 64 join copies with a word or two changed. ``keep_one``, which a pipeline uses, takes
near-duplicates at a similarity of 0.8 of five-word shingles, whose fingerprints differ in a seventh
of their bits: by the shingles themselves, of which such texts share one of the first fifth.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, WHITE, mix, pieces, word_hashes, words
from .scratch import PREFIX, drawn, let, materialize, unwrap, wrap

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
DENSE_LIMIT = 8192
SALTS = 8


def _masks() -> list[int]:
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(blocks[i] for i in kept) for kept in combinations(range(BLOCKS), BLOCKS - DISTANCE)]


#: The bits that each table's key keeps.
MASKS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_sums(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, from the highest bit on."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[at : at + (1 << 16)], np.uint64).astype(">u8")
        out += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return out


def fingerprint_column(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of whole texts, as signed 64-bit numbers; 0 for a text without a word."""
    from xxhash import xxh64_intdigest

    sums, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    carry: list[bytes] = []
    for p in pieces(texts, separators=WHITE):
        raw = p.data.tobytes().lower()
        for k, row in enumerate(p.rows):
            words = raw[p.bounds[k] : p.bounds[k + 1]].split()
            if k == 0 and p.goes_on:
                words = carry + words
            last = not (p.cut and k == len(p.rows) - 1)
            if len(words) >= shingle:
                grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
                found = [xxh64_intdigest(g, SEED) for g in grams]
            elif words and last and not n[row]:
                found = [xxh64_intdigest(b" ".join(words), SEED)]
            else:
                found = []
            carry = [] if last else words[max(0, len(words) - shingle + 1) :]
            if found:
                sums[row] += bit_sums(found)
                n[row] += len(found)
    return np.packbits(2 * sums > n[:, None], axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row ``(id, fp)`` for each row of ``docs``; a null text counts as empty."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_column(batch.column(1), shingle), pa.int64())], names=["id", "fp"])

    return narrow.mapInArrow(run, schema)


def star_links(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the first of its group, groups being what the distance joins."""
    left, a, b = np.sort(fps), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                near |= (np.bitwise_count(front[at : at + 64, None] ^ left[None, :]) <= distance).any(0)
            front, left = left[near], left[~near]
            a.append(np.full(len(front), root))
            b.append(front)
        if not a and not len(left):
            break
    empty = np.zeros(0, fps.dtype)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        edges = lists.offsets.to_numpy(zero_copy_only=False)
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        x, y = values[two], values[two + 1]
        near = np.bitwise_count(x ^ y) <= DISTANCE
        found = [(x[near], y[near]), *(star_links(values[edges[i] : edges[i + 1]]) for i in np.flatnonzero(sizes > 2))]
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])


def _centres(table: Column) -> Column:
    """(flip, far) of the centres of a key: within one bit (far 0) and at two (far 1), over its free bits."""
    free = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in MASKS]), table + 1)
    centre = lambda flip, far: F.struct(flip.alias("flip"), F.lit(far).alias("far"))
    one = lambda f: F.transform(f, lambda x: centre(x, 0))
    two = lambda f: F.flatten(F.transform(f, lambda x, i: F.transform(F.slice(f, i + 2, 64), lambda y: centre(x.bitwiseOR(y), 1))))
    return let(free, lambda f: F.concat(F.array(centre(F.lit(0).cast("long"), 0)), one(f), two(f)))


def links(classes: DataFrame, *, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """Distinct links (u, v) between different fingerprints: enough to join all within the distance."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(MASKS)])
    keyed = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    # Counted before any key is gathered; few keys are hot, as each has so many fingerprints.
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n"))
    hot_keys = materialize(counts.where(F.col("n") > dense_limit).select(F.col("t").alias("ht"), F.col("key").alias("hkey")), "simhash-hot")
    any_hot = not hot_keys.isEmpty()
    is_hot = (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hkey"))
    few = keyed.join(hot_keys, is_hot, "left_anti") if any_hot else keyed
    buckets = few.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    dense = buckets.mapInArrow(_bucket_links, "u long, v long")
    if not any_hot:
        return dense.distinct()
    hot = keyed.join(hot_keys, is_hot, "left_semi").select("fp", "t", F.explode(_centres(F.col("t"))).alias("c")).select("fp", "t", F.col("fp").bitwiseXOR(F.col("c.flip")).alias("centre"), "c.far")
    at_centre = hot.groupBy("t", "centre").agg(F.min(F.when(F.col("far") == 0, F.col("fp"))).alias("root"), F.collect_list("fp").alias("fps")).where(F.col("root").isNotNull() & (F.size("fps") > 1))
    sparse = at_centre.select("root", F.explode("fps").alias("fp")).where("fp <> root").select(F.least("root", "fp").alias("u"), F.greatest("root", "fp").alias("v"))
    return dense.unionByName(sparse).distinct()


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never sent whole to the driver and to every executor.

    Tables that were written are planned by the size of their compressed files, which for ids and links
    is a small part of what they take in memory; what grows with the input is dealt out by the join's key.
    """
    return df.hint("merge")


def _smallest_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with m, the smallest v or u of each u. A node with many pairs is salted."""
    least = pairs.groupBy("u").agg(F.min("v").alias("v_min")).select(F.col("u").alias("x"), F.least("u", "v_min").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("xs"))
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(_dealt(least), (F.col("u") == F.col("x")) & (F.col("s") == F.col("xs"))).select("u", "v", "m")


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node it reaches."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components")
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Here u is the larger end, so v and m are the ends that a small star joins.
        small = _smallest_neighbour(large)
        joined = small.where("v <> m").select(F.col("m").alias("u"), "v").unionByName(small.select(F.col("m").alias("u"), F.col("u").alias("v")))
        after = materialize(joined.where("u <> v").distinct(), "components")
        last, seen, now = seen, state(after), after
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_groups(fps: DataFrame, *, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """``(id, fp, component_id)`` of each row of a written table ``(id, fp)``.

    component_id is the smallest non-null id of all rows that links reach. Rows with equal
    fingerprints share a class, so copies are never paired.
    """
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = components(links(classes, dense_limit=dense_limit))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    known = materialize(members.join(_dealt(classes), F.col("node") == F.col("fp")).select("fp", "root", "least"), "simhash-members")
    least = known.groupBy("root").agg(F.min("least").alias("group_least"))
    grouped = known.join(_dealt(least), "root").select(F.col("fp").alias("linked"), "group_least")
    named = materialize(classes.join(_dealt(grouped), F.col("fp") == F.col("linked"), "left").select(F.col("fp").alias("class"), F.coalesce("group_least", "least").alias("component_id")), "simhash-named")
    return fps.join(_dealt(named), F.col("fp") == F.col("class")).select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``.

    Texts without a word, null ones included, have fingerprint zero and link like any other. A
    null id is no component_id unless all ids of the group are null; rows and ids may repeat; an
    empty table gives no rows; other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-fingerprints")
    return near_groups(fps, dense_limit=dense_limit).withColumnRenamed("id", id_col)


#: Seeds of the four words of 64 bits that a signature has of each kind.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Words of the shingles that are compared, and of those whose fingerprints are cut into blocks.
COMPARED, BLOCKED = 5, 2
#: Fingerprints of texts at a shingle similarity of 0.8 differ in a share of acos(8 / 9) / pi of their 256 bits,
#: 38.8 on average with a deviation of 5.7 (48 and 6.2 where five shingles stand against four). FAR is more
#: than five deviations beyond, and six below the 128 of texts that share nothing. Pairs within it are counted.
FAR = 80
#: Texts of which frequent shingles are learnt, and how many of these are told.
SAMPLE, FREQUENT = 1 << 14, 1 << 15
#: A group with more members, or with more shingles in all, is cut into chunks.
GROUP_MEMBERS, GROUP_SHINGLES = 2048, 1 << 20
_SPREAD = np.array([int.from_bytes(bytes((b >> (7 - i)) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of texts (word hashes, bounds), and the bounds of each text's.

    A text of fewer words, but not none, has one run of all its words.
    """
    sizes = np.diff(bounds)
    many = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    cut = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(bounds[:-1] - cut[:-1], many) + np.arange(cut[-1])
    length = np.repeat(np.minimum(sizes, width), many)
    out = np.zeros(cut[-1], np.uint64)
    for j in range(width):
        own = length > j
        out[own] = mix(out[own] * np.uint64(SEEDS[0]) ^ h[first[own] + j])
    return out, cut


def majority_bits(shingles: np.ndarray, cut: np.ndarray, seed: int) -> np.ndarray:
    """A word of 64 bits for each text: bits that are set in more than half of its shingles' hashes under a seed."""
    sums, n = np.zeros((len(cut) - 1, 64), np.int64), np.diff(cut)
    rows = np.arange(len(n))
    for at in range(0, len(shingles), 1 << 18):  # bounds the memory
        x = mix(shingles[at : at + (1 << 18)] ^ np.uint64(seed))
        # Eight counters of a byte in each number, of 255 shingles at most, are added at once.
        starts = np.unique(np.concatenate([np.arange(0, len(x), 255), cut[(cut > at) & (cut < at + len(x))] - at]))
        lanes = np.add.reduceat(_SPREAD[x.view(np.uint8).reshape(-1, 8)], starts, axis=0)
        owner = np.searchsorted(cut, starts + at, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums[rows[owner[first]]] += np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def signature_column(texts: pa.Array) -> np.ndarray:
    """Fingerprints by all runs, repeated ones too; ``keep_one`` compares distinct ones (``signatures``).

    Eight words of 64 bits for each whole text: four over runs of BLOCKED words, then four over runs of COMPARED words."""
    out = np.zeros((len(texts), 8), np.uint64)

    def put(rows: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> None:
        for k, width in enumerate((BLOCKED, COMPARED)):
            found, cut = shingle_hashes(h, bounds, width)
            for i, seed in enumerate(SEEDS):
                out[rows, 4 * k + i] = majority_bits(found, cut, seed)

    parts: list[np.ndarray] = []
    for p in pieces(texts, separators=WHITE):
        data = LOWER[p.data]
        starts, ends = words(data, p.bounds, WHITE)
        h = word_hashes(data, starts, ends)
        if not (p.goes_on or p.cut):
            put(p.rows, h, np.searchsorted(starts, p.bounds))
            continue
        parts.append(h)  # of one long text
        if not p.cut:
            whole = np.concatenate(parts)
            put(p.rows, whole, np.array([0, len(whole)]))
            parts = []
    return out.view(np.int64)


_BITS = [f"v{i}" for i in range(4)]


def _ranks(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """0 for a shingle that is not in ``frequent`` (rarest first), else its place there, from 1 on."""
    if not len(frequent):
        return np.zeros(len(shingles), np.int64)
    order = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent, shingles, sorter=order), len(frequent) - 1)
    return np.where(frequent[order[at]] == shingles, order[at] + 1, 0)


def distinct_shingles(h: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's runs of ``COMPARED`` words, frequent ones last, and the bounds of each text's.

    The order is the same in all texts, so that two texts' first ones tell whether they can be similar.
    """
    found, cut = shingle_hashes(h, bounds, COMPARED)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((found, _ranks(found, frequent), owner))
    found, owner = found[order], owner[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[first], np.searchsorted(owner[first], np.arange(len(cut)))


def _text_sets(texts: pa.Array, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``distinct_shingles`` of all texts, in their order, some at a time."""
    parts: list[np.ndarray] = []
    for p in pieces(texts, separators=WHITE):
        data = LOWER[p.data]
        starts, ends = words(data, p.bounds, WHITE)
        h = word_hashes(data, starts, ends)
        if not (p.goes_on or p.cut):
            yield distinct_shingles(h, np.searchsorted(starts, p.bounds), frequent)
            continue
        parts.append(h)  # of one long text
        if not p.cut:
            whole = np.concatenate(parts)
            yield distinct_shingles(whole, np.array([0, len(whole)]), frequent)
            parts = []


def prefixes(sizes: np.ndarray) -> np.ndarray:
    """Of sets of ``sizes`` elements so many first ones that two at a similarity of 4 / 5 have one of them in common.

    They share 4 / 5 of either at least, so the rest after that many cannot be all that they share.
    """
    return np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0)


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(id, e0, e1, v0..v3, keys)`` for each row (id, text); a null text counts as empty, which has no keys.

    Texts with equal e0 and e1 have the same shingles; v0 to v3 are 256 bits of which similar texts share most;
    keys are a text's first shingles.
    """
    longs = ["e0", "e1", *_BITS]
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, keys, many = [np.zeros((0, 6), np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for found, cut in _text_sets(batch.column(1), frequent):
                own = np.zeros((len(cut) - 1, 6), np.uint64)
                for k, seed in enumerate(SEEDS[:2]):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ np.uint64(seed)), dtype=np.uint64)])
                    own[:, k] = sums[cut[1:]] - sums[cut[:-1]]
                for k, seed in enumerate(SEEDS):
                    own[:, 2 + k] = majority_bits(found, cut, seed)
                n = prefixes(np.diff(cut))
                at = np.cumsum(n) - n
                columns.append(own)
                keys.append(found[np.repeat(cut[:-1] - at, n) + np.arange(n.sum())])
                many.append(n)
            whole = np.concatenate(columns).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(many)), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(whole[:, i])) for i in range(6)], lists], names=["id", *longs, "keys"])

    return docs.mapInArrow(run, schema)


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that several of about ``SAMPLE`` texts (cid, text) have, rarest first.

    They go last in the order of shingles, which keeps them from being keys. Any order gives the same pairs.
    """
    share = SAMPLE / max(1, texts.count())
    some = texts.where(drawn(SEED, F.col("cid"), share)) if share < 1 else texts
    each = some.select(F.lit(0).cast("long").alias("root"), "cid", "text").mapInArrow(_shingle_sets, _SETS)
    most = each.select(F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where("n > 8").orderBy(F.desc("n"), "x").limit(FREQUENT)
    return np.array([r["x"] for r in most.collect()][::-1], np.int64).view(np.uint64)


def group_links(ids: np.ndarray, bits: np.ndarray, far: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the groups that rows within ``far`` bits of each other form, each to the first of its group.

    They say which rows are to be compared, not which are similar: ``exact_groups`` finds that out for all
    pairs of a group, so links as many as rows lose none.
    """
    order = np.argsort(ids)
    ids, bits = ids[order], bits[order]
    left, found = np.arange(len(ids)), [(np.zeros(0, np.int64),) * 2]
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 16):
                h = np.bitwise_count(bits[front[at : at + 16], None, :] ^ bits[None, left, :]).sum(2, dtype=np.int64)
                near |= (h <= far).any(0)
            front, left = left[near], left[~near]
            found.append((np.full(len(front), root), front))
    u, v = (np.concatenate([f[k] for f in found]) for k in range(2))
    return ids[u], ids[v]


def _similar_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        held = lists.values
        ids = held.field(0).to_numpy(zero_copy_only=False)
        bits = np.stack([held.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(1, 5)], axis=1)
        edges = lists.offsets.to_numpy(zero_copy_only=False)
        found = [group_links(ids[i:j], bits[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        u, v = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


_SETS = "root long, cid long, shingles array<long>"


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, cid, text) batches to (root, cid, the distinct hashes of the text's runs of COMPARED words)."""
    for batch in batches:
        values, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for found, cut in _text_sets(batch.column(2), np.zeros(0, np.uint64)):
            values.append(found)
            sizes.append(np.diff(cut))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["root", "cid", "shingles"])


def set_links(ids: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the groups that sets at a similarity of 4 / 5 or more form, each to the first of its group."""
    names, tokens = np.unique(values, return_inverse=True)
    sizes, mark = np.diff(bounds), np.zeros(len(names), bool)
    left, found = np.argsort(ids), [(np.zeros(0, np.int64),) * 2]
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near, n = np.zeros(len(left), bool), sizes[left]
            at = np.cumsum(n) - n
            flat = tokens[np.repeat(bounds[left] - at, n) + np.arange(n.sum())]
            for x in front:
                own = tokens[bounds[x] : bounds[x + 1]]
                mark[own] = True
                shared = np.add.reduceat(mark[flat], at, dtype=np.int64)
                mark[own] = False
                near |= 5 * shared >= 4 * (sizes[x] + n - shared)
                if near.all():
                    break
            front, left = left[near], left[~near]
            found.append((np.full(len(front), root), front))
    u, v = (np.concatenate([f[k] for f in found]) for k in range(2))
    return ids[u], ids[v]


def _set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        held, edges = lists.values, lists.offsets.to_numpy(zero_copy_only=False)
        ids, sets = held.field(0).to_numpy(zero_copy_only=False), held.field(1)
        values, bounds = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        found = [set_links(ids[i:j], values[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        u, v = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _in_chunks(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, cid, chunks) once for each two chunks (lo, hi) that theirs is one of; of a single chunk, once."""
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))
    two = lambda x: F.struct(F.least("own", x).alias("lo"), F.greatest("own", x).alias("hi"))
    alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    dealt = F.inline(F.when(F.col("chunks") == 1, alone).otherwise(F.transform(others, two)))
    rest = [c for c in rows.columns if c != "chunks"]
    return rows.withColumn("own", F.pmod(F.xxhash64("cid", by), F.col("chunks")).cast("int")).select(*rest, dealt)


def exact_groups(groups: DataFrame, texts: DataFrame, *, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """(node, root) of what is similar within each of ``groups`` (node, root), by the shingles of texts (cid, text).

    All pairs of a group are looked at but for those that links join already. A group with more than
    ``GROUP_MEMBERS`` members, or more than ``GROUP_SHINGLES`` shingles, is cut into chunks as keys are.
    """
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    mine = texts.join(_dealt(members), F.col("cid") == F.col("node")).select("root", "cid", "text")
    sets = materialize(mine.mapInArrow(_shingle_sets, _SETS), "simhash-shingles")
    many = F.greatest(F.count("*") / min(dense_limit, GROUP_MEMBERS), F.sum(F.size("shingles")) / GROUP_SHINGLES)
    chunks = materialize(sets.groupBy("root").agg(F.ceil(many).cast("int").alias("chunks")), "simhash-chunks")
    held = _in_chunks(sets.join(_dealt(chunks), "root"), "root").groupBy("root", "lo", "hi").agg(F.collect_list(F.struct("cid", "shingles")).alias("members"))
    found = held.where(F.size("members") > 1).select("members").mapInArrow(_set_links, "u long, v long")
    if chunks.where("chunks > 1").isEmpty():  # each group was seen whole, so its links are from each to the first
        return found.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return components(found)


def similar_links(classes: DataFrame, *, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """Distinct links (u, v) that join the classes (cid, v0..v3, keys) that share a key and are within ``FAR`` bits.

    A key gives as many links as members, see ``group_links``. A key with more than ``dense_limit``
    members is cut into chunks by a hash, and each two chunks are looked at together, so no task
    holds more than twice the limit.
    """
    keyed = classes.select("cid", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = keyed.join(_dealt(sizes), "key").select("cid", "key", F.ceil(F.col("n") / dense_limit).cast("int").alias("chunks"))
    held = _in_chunks(live, "key").join(_dealt(classes.select("cid", *_BITS)), "cid").groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("cid", *_BITS)).alias("members"))
    return held.where(F.size("members") > 1).select("members").mapInArrow(_similar_links, "u long, v long").distinct()


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """The rows of ``docs``, with all columns, of which one for each group of near-duplicates: that with the smallest id.

    Near-duplicates have a similarity (Jaccard) of distinct five-word shingles of 0.8 or more. Two such
    texts have one of their first fifths of shingles in common, in an order of all shingles that has
    frequent ones last. Those that share such a key and differ in no more than ``FAR`` of 256 bits are
    joined to groups to be compared, and within a group the shingles of all pairs decide.

    Rows are told apart by a number of their own, written with them, so repeated and null ids
    are as good as others; of equal ids the first row stays, and null ids come last. Texts without
    a word, null ones included, are copies of each other. An empty table gives no rows.
    """
    row = F.col(PREFIX + "row")
    numbered = materialize(wrap(docs).select(row, F.monotonically_increasing_id().alias("rid")), "simhash-rows")
    rank: Column = F.struct(row[id_col].isNull().alias("unknown"), row[id_col].alias("doc"), F.col("rid"))
    texts = numbered.select(F.col("rid").alias("cid"), row[text_col].alias("text"))
    found = signatures(numbered.select(rank.alias("id"), row[text_col].alias("text")), frequent_shingles(texts))
    # Texts of the same shingles are one class from here on, however many.
    first = F.min(F.struct("id", *_BITS, "keys")).alias("first")
    classes = materialize(found.groupBy("e0", "e1").agg(first).select(F.col("first.id").alias("least"), F.col("first.id.rid").alias("cid"), *[f"first.{c}" for c in (*_BITS, "keys")]), "simhash-classes")
    near = components(similar_links(classes, dense_limit=dense_limit))
    roots = materialize(exact_groups(near, texts, dense_limit=dense_limit), "simhash-roots")
    of = classes.select("least", "cid").join(_dealt(roots), F.col("cid") == F.col("node"), "left")
    kept = of.groupBy(F.coalesce("root", "cid").alias("group")).agg(F.min("least")["rid"].alias("kept"))
    return numbered.join(_dealt(kept), F.col("rid") == F.col("kept"), "left_semi").select(*unwrap(docs.columns, []))
