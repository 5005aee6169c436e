"""Language-model scores from a log-frequency Bloom filter.

Counting. Training texts are cut into words and an end mark each. Unigrams and bigrams are
counted over all of them: each task counts chunks of text, and sends sorted hashes as packed
blobs, dealt by hash range, so a frequent n-gram is one entry for each chunk of a million tokens.

Filter. A count c is quantised to level 1 + floor(log c / log BASE), and an n-gram is put into the
filter once for each level up to its own, so its count is read by probing level after level
until one is missing. Every n-gram is put in, those seen once too. The hashes are dealt to ranges,
in number as the text needs; each range has a filter of its own, sized from its own levels. The
workers that probe a range's filter are sent that filter alone: chunks of text ask it for the
distinct n-grams that they hold and get their levels back. No filter is gathered or broadcast
whole, so it grows with the corpus.

Score. p(w | v) = WEIGHT * c(v w) / c(v) + (1 - WEIGHT) * (c(w) + 1) / (N + V + 1), with all
counts from the filter. A probe that finds a level too many takes a count for up to BASE times its
own; at half load and HASHES bits that is one in 2**HASHES for each level.

The exact add-one baseline needs exact counts, which the ranges send along for words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, WHITE, mix, pieces, word_hashes, words
from .scratch import materialize

BASE = math.sqrt(2)
HASHES = 5
BLOCK_BITS = 1 << 19
WEIGHT = 0.2
#: Bytes of text for each range of hashes.
ASKED_BYTES = 16 << 20
#: Tokens of a chunk.
CHUNK_TOKENS = 1 << 20
#: The end mark, which also stands before the first word. No word has this hash.
END = np.uint64(0)
LEVELS = 64


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """48-bit hashes of bigrams."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x632BE59BD9B4E019))) >> np.uint64(16)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised level of counts of 1 or more."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def _level_counts() -> np.ndarray:
    """The count that each level stands for: the geometric middle of its whole numbers; 0 for level 0."""
    out = np.zeros(LEVELS + 1)
    for q in range(1, LEVELS + 1):
        low, high = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out[q] = math.sqrt(low * max(low, high))
    return out


LEVEL_COUNTS = _level_counts()


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes and their counts: differences and counts by byte planes, compressed."""
    import zstandard

    steps = np.diff(hashes, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their summed counts."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first)


@dataclass
class Tokens:
    """The tokens of a piece of texts: their hashes, those before them, and the row of each."""

    h: np.ndarray
    before: np.ndarray
    row: np.ndarray


def token_pieces(column: pa.Array) -> Iterator[Tokens]:
    """All tokens of a column, a piece at a time. A null or empty text has its end mark alone."""
    last = END
    for p in pieces(column, separators=WHITE):
        data = LOWER[p.data]
        starts, ends = words(data, p.bounds, WHITE)
        h = word_hashes(data, starts, ends)
        per = np.diff(np.searchsorted(starts, p.bounds))
        ended = np.ones(len(p.rows), np.int64)
        if p.cut:
            ended[-1] = 0
        size = per + ended
        total = int(size.sum())
        out = np.full(total, END, np.uint64)
        is_end = np.zeros(total, bool)
        is_end[(np.cumsum(size) - 1)[ended == 1]] = True
        out[~is_end] = h
        before = np.empty(total, np.uint64)
        if total:
            before[0] = last if p.goes_on else END
            before[1:] = out[:-1]  # after an end mark, that mark
            last = out[-1]
        yield Tokens(out, before, np.repeat(p.rows, size))


class CountFilter:
    """A Bloom filter of (n-gram, level), in blocks; n-grams of both kinds are told apart by a mark."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # (blocks, bytes of a block)

    @staticmethod
    def key(kind: int, h: np.ndarray) -> np.ndarray:
        return mix(h ^ np.uint64(0xA0761D6478BD642F if kind == 1 else 0xE7037ED1A0B428DB))

    @staticmethod
    def steps(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two hashes whose combinations are the places of all levels."""
        return key & np.uint64(0xFFFFFFFF), mix(key) | np.uint64(1)

    @staticmethod
    def place(first: np.ndarray, step: np.ndarray, level: int, k: int) -> np.ndarray:
        """The bit of the k-th hash of a level in the key's block."""
        return (first + step * np.uint64(level * HASHES + k)) & np.uint64(BLOCK_BITS - 1)

    @staticmethod
    def block(key: np.ndarray, n_blocks: int) -> np.ndarray:
        return (key >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)

    def levels(self, kind: int, h: np.ndarray) -> np.ndarray:
        """The highest level of each n-gram for which it and all lower ones are in the filter."""
        out = np.zeros(len(h), np.int64)
        key, flat = self.key(kind, h), self.bits.reshape(-1)
        base = self.block(key, len(self.bits)) * np.uint64(BLOCK_BITS)
        first, step = self.steps(key)
        live = np.arange(len(h))
        for level in range(1, LEVELS + 1):
            for k in range(HASHES):
                at = base + self.place(first, step, level, k)
                there = flat[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
                if not there.all():
                    live, base, first, step = live[there], base[there], first[there], step[there]
            if not len(live):
                break
            out[live] = level
        return out

    def counts(self, kind: int, h: np.ndarray) -> np.ndarray:
        return LEVEL_COUNTS[self.levels(kind, h)]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of its values each entry has, and the values, by hashing."""
    import pandas as pd

    codes, values = pd.factorize(h.view(np.int64))
    return codes, values.view(np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def expand(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def filter_of(kind: int, h: np.ndarray, counts: np.ndarray) -> CountFilter:
    """The filter of some n-grams, all put in, as large as their levels need at half load."""
    level = level_of(counts)
    n_blocks = max(1, math.ceil(int(level.sum()) * HASHES / math.log(2) / BLOCK_BITS))
    flags = np.zeros(n_blocks * BLOCK_BITS, bool)
    key = CountFilter.key(kind, h)
    base = CountFilter.block(key, n_blocks) * np.uint64(BLOCK_BITS)
    first, step = CountFilter.steps(key)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = level >= q
        for k in range(HASHES):
            flags[(base[own] + CountFilter.place(first[own], step[own], q, k)).view(np.int64)] = True
    return CountFilter(np.packbits(flags, bitorder="little").reshape(n_blocks, -1))


def sorted_distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of its sorted values each entry has, and the values."""
    codes, values = distinct(h)
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[codes], values[order]


def range_runs(values: np.ndarray, top: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of the ranges that hold some of these sorted hashes of ``top`` bits.

    Only those are visited, so a chunk costs as much as its n-grams however many ranges there are.
    """
    if not len(values):
        return
    part = (values >> np.uint64(top - 32)) * np.uint64(ranges) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    yield from zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True)


def score_corpus(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``, by a model of those for which ``train`` is true.

    Every n-gram of them is counted and put into a filter. A chunk of text is written with the
    numbers of its tokens in its own list of words, and sends each range of hashes its distinct
    n-grams with their counts in training texts; those that only other texts have are sent with 0,
    and get what the filter says of them. Nothing that grows with the corpus is broadcast.

    A null or empty text is its end mark alone. Ids may be null or repeat: rows have numbers of
    their own. Without training rows all counts are 0; an empty table gives no rows. Other columns
    are not read. Words are known by 64-bit hashes, bigrams by 48-bit ones.
    """
    narrow = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid")).alias("key"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    key_type = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("rid", T.LongType())])
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    ranges = max(16, math.ceil(size / ASKED_BYTES))
    schema = T.StructType(
        [
            *[T.StructField(x, t) for x, t in (("chunk", T.LongType()), ("kind", T.IntegerType()), ("part", T.LongType()), ("blob", T.BinaryType()), ("words", T.BinaryType()), ("sizes", T.BinaryType()), ("first", T.LongType()))],
            T.StructField("keys", T.ArrayType(key_type)),
        ]
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[Tokens, np.ndarray, np.ndarray, pa.Array]] = []  # tokens, train, sizes and keys of rows
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, before = (np.concatenate([getattr(t[0], x) for t in held]) for x in ("h", "before"))
            weights = np.concatenate([t[1] for t in held])
            codes, words_ = sorted_distinct(np.concatenate([before[:1], h]))
            which, pairs = sorted_distinct(pair_hashes(before, h))
            rows = [(0, 0, squeeze(codes[1:].astype(np.uint32)), squeeze(np.diff(words_, prepend=np.uint64(0))), squeeze(np.concatenate([t[2] for t in held]).astype(np.uint32)), int(before[:1].view(np.int64)[0]))]
            for kind, top, values, own in ((1, 64, words_, codes[1:]), (2, 48, pairs, which)):
                c = np.bincount(own, weights=weights, minlength=len(values)).astype(np.int64)
                for part, a, b in range_runs(values, top, ranges):
                    rows.append((kind, part, pack(values[a:b], c[a:b]), None, None, None))
            keys = pa.concat_arrays([t[3] for t in held])
            lists = pa.ListArray.from_arrays(pa.array([0, *[len(keys)] * len(rows)], pa.int32()), keys)
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), *[pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], lists], names=schema.names)

        for batch in batches:
            is_train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for t in token_pieces(batch.column(1)):
                if not len(t.h):
                    continue
                at = np.flatnonzero(np.concatenate([[True], t.row[1:] != t.row[:-1]]))
                held.append((t, is_train[t.row], np.diff(np.concatenate([at, [len(t.row)]])), batch.column(0).take(pa.array(t.row[at]))))
                n += len(t.h)
                if n >= CHUNK_TOKENS:
                    yield from flush()
                    held, n, chunk = [], 0, chunk + 1
        if n:
            yield from flush()

    def answer(table: pa.Table) -> pa.Table:
        kind, chunks, blobs = table.column("kind")[0].as_py(), table.column("chunk").to_pylist(), table.column("blob")
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for blob in blobs:
            found.append(unpack(blob.as_py()))
            waiting += len(found[-1][0])
            if waiting > max(1 << 20, len(h)):
                h, c = summed(np.concatenate([h, *[x[0] for x in found]]), np.concatenate([c, *[x[1] for x in found]]))
                found, waiting = [], 0
        h, c = summed(np.concatenate([h, *[x[0] for x in found]]), np.concatenate([c, *[x[1] for x in found]]))
        found = []
        seen = c > 0
        levels = filter_of(kind, h[seen], c[seen]).levels(kind, h).astype(np.uint8)
        out = [(-1, None, None)]  # for the sums of the range
        for chunk, blob in zip(chunks, blobs, strict=True):
            at = np.searchsorted(h, unpack(blob.as_py())[0])
            out.append((chunk, squeeze(levels[at]), squeeze(c[at].astype(np.uint64)) if kind == 1 else None))
        m, part = len(out), table.column("part")[0].as_py()
        totals = [[int(x), *[0] * (m - 1)] for x in (c.sum(), seen.sum())]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([kind] * m, pa.int32()), "part": pa.array([part] * m, pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary()), "words": pa.array([x[2] for x in out], pa.binary()), "n": pa.array(totals[0], pa.int64()), "v": pa.array(totals[1], pa.int64())})

    asked = materialize(narrow.mapInArrow(ask, schema), "lm-asked")
    answers = materialize(asked.where("kind > 0").select("chunk", "kind", "part", "blob").groupBy("kind", "part").applyInArrow(answer, "chunk long, kind int, part long, blob binary, words binary, n long, v long"), "lm-answers")
    total = answers.where("kind = 1 and chunk = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, v_train = int(total["n"] or 0), int(total["v"] or 0)
    scored = T.StructType([T.StructField("key", key_type), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known")], *[T.StructField(x, T.DoubleType()) for x in ("known", "score")]])

    def score(table: pa.Table) -> pa.Table:
        rows = sorted(range(table.num_rows), key=lambda i: (table.column("kind")[i].as_py(), table.column("part")[i].as_py()))
        kinds = table.column("kind").to_pylist()
        get = lambda name, i: table.column(name)[i].as_py()
        codes, words_ = expand(get("blob", rows[0]), np.uint32).astype(np.int64), np.cumsum(expand(get("words", rows[0]), np.uint64), dtype=np.uint64)
        sizes, first = expand(get("sizes", rows[0]), np.uint32).astype(np.int64), np.array([get("first", rows[0])], np.int64).view(np.uint64)
        levels = {k: np.concatenate([expand(get("blob", i), np.uint8) for i in rows if kinds[i] == k]) for k in (1, 2)}
        exact = np.concatenate([expand(get("words", i), np.uint64) for i in rows if kinds[i] == 1])[codes].astype(np.float64)
        h = words_[codes]
        before = np.concatenate([first, h[:-1]])  # after an end mark, that mark
        by_word = LEVEL_COUNTS[levels[1]]
        own = by_word[codes]
        given = np.concatenate([by_word[np.searchsorted(words_, first)], own[:-1]])
        which, _ = sorted_distinct(pair_hashes(before, h))
        pair = np.where((own > 0) & (given > 0), LEVEL_COUNTS[levels[2]][which], 0.0)
        share = np.minimum(pair / np.maximum(given, 1), 1.0)
        logs = np.log10(weight * share + (1 - weight) * (own + 1) / (n_train + v_train + 1))
        of, m = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        sums = [np.bincount(of, weights=x, minlength=m) for x in (np.log10(exact + 1), logs)]
        keys = table.column("keys").combine_chunks()[rows[0]].values
        return pa.table({"key": keys, "n_tokens": pa.array(sizes), "n_known": pa.array(np.bincount(of[exact > 0], minlength=m)), "known": pa.array(sums[0]), "score": pa.array(sums[1])})

    frames = asked.where("kind = 0").select("chunk", "kind", "part", "blob", "words", "sizes", "first", "keys")
    back = answers.where("chunk >= 0").select("chunk", "kind", "part", "blob", "words")
    parts = frames.unionByName(back, allowMissingColumns=True).groupBy("chunk").applyInArrow(score, scored)
    # A long text may have tokens in several chunks.
    whole = parts.groupBy("key").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "known", "score")])
    norm = math.log10(n_train + v_train + 1)
    return whole.select(
        F.col("key.id").alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("known") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )
