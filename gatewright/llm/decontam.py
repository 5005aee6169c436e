"""Benchmark decontamination as a prefix-filtered set join.

An item's shingles are its windows of 13 consecutive words (a shorter item is one window). A
window is contained in a text only if all its words are, so one word is a sufficient prefix:
the rarest, by the number of all texts that hold it. Places of these prefix words are the
candidates; a candidate must lie so that the whole window fits into the text (length and
positional bounds), and is verified word for word.

The items are taken in blocks of bounded size, each block's index is broadcast, and all texts
pass by each block, so a benchmark of any size can be joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, PUNCT, PUNCT_RAW, pieces, word_hashes, words
from .scratch import PREFIX, materialize, unwrap, wrap

WINDOW = 13
#: Bytes of benchmark text in one block. Its index takes some twenty times as much in each worker.
BLOCK_BYTES = 4 << 20


@dataclass
class ItemWindows:
    """The distinct windows of a block of items."""

    vocab: np.ndarray  # sorted word hashes
    windows: np.ndarray  # (windows, width) word numbers, -1 beyond the length
    lengths: np.ndarray
    names: list[str]  # item ids, sorted
    first_item: np.ndarray  # window -> first of its entries below
    item: np.ndarray  # item numbers


@dataclass
class WindowIndex:
    of: ItemWindows
    first: np.ndarray  # word number -> first of its entries below
    entry_window: np.ndarray  # a window of which this word is the prefix
    entry_at: np.ndarray  # where the word stands in it


def text_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) of each row that has bytes, in order."""
    parts: list[np.ndarray] = []
    for p in pieces(column, separators=PUNCT_RAW):
        data = LOWER[p.data]
        starts, ends = words(data, p.bounds, PUNCT)
        h = word_hashes(data, starts, ends)
        cut = np.searchsorted(starts, p.bounds)
        for k, row in enumerate(p.rows):
            parts.append(h[cut[k] : cut[k + 1]])
            if not (p.cut and k == len(p.rows) - 1):
                yield int(row), parts[0] if len(parts) == 1 else np.concatenate(parts)
                parts = []


def numbered(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number of each hash in the sorted vocabulary; -1 for those that are not in it."""
    if not len(vocab):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    return np.where(vocab[at] == h, at, -1)


def item_windows(items: list[tuple[str, str | None]], width: int = WINDOW) -> ItemWindows:
    """All distinct windows of the items, with the items that hold each."""
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    found = list(text_words(pa.array([t for _, t in items], pa.string())))
    found = [(number[items[row][0]], h) for row, h in found if len(h)]
    sizes = np.array([len(h) for _, h in found], np.int64)
    vocab, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, h in found]]), return_inverse=True)
    many = np.maximum(sizes - width + 1, 1)
    before = np.cumsum(sizes) - sizes
    start = np.repeat(before - (np.cumsum(many) - many), many) + np.arange(many.sum())
    length = np.repeat(np.minimum(sizes, width), many)
    owner = np.repeat(np.array([n for n, _ in found], np.int64), many)
    places = start[:, None] + np.arange(width)
    table = np.where(np.arange(width) < length[:, None], ids[np.minimum(places, max(len(ids) - 1, 0))] if len(ids) else -1, -1).astype(np.int32)
    _, one, same = np.unique(np.ascontiguousarray(table).view(np.dtype((np.void, 4 * width))).ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(same * max(len(names), 1) + owner) if len(owner) else np.zeros(0, np.int64)
    window, item = pairs // max(len(names), 1), pairs % max(len(names), 1)
    return ItemWindows(vocab, table[one], length[one], names, np.searchsorted(window, np.arange(len(one) + 1)), item)


def word_frequencies(docs: DataFrame, vocab: np.ndarray, text_col: str) -> np.ndarray:
    """In how many texts of all ``docs`` each word of the vocabulary stands."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros(len(v), np.int64)
        for batch in batches:
            for _, h in text_words(batch.column(0)):
                n = numbered(v, h)
                total[np.unique(n[n >= 0])] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocab), np.int64)
    out[counts.column("word").to_numpy()] = counts.column("n").to_numpy()
    return out


def build_index(of: ItemWindows, frequency: np.ndarray) -> WindowIndex:
    """The windows keyed by their rarest word."""
    if not len(of.windows):
        return WindowIndex(of, np.zeros(len(of.vocab) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.where(of.windows >= 0, frequency[of.windows], np.iinfo(np.int64).max).argmin(1)
    word = of.windows[np.arange(len(at)), at]
    order = np.argsort(word, kind="stable")
    return WindowIndex(of, np.searchsorted(word[order], np.arange(len(of.vocab) + 1)), order, at[order])


def find_windows(index: WindowIndex, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence of a window in a text of these words."""
    of = index.of
    n = numbered(of.vocab, h)
    known = np.flatnonzero(n >= 0)
    many = index.first[n[known] + 1] - index.first[n[known]]
    known, many = known[many > 0], many[many > 0]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, (1 << 20) // max(int(many.max(initial=1)), 1))
    for lo in range(0, len(known), step):  # so that candidates take bounded memory
        place, count = known[lo : lo + step], many[lo : lo + step]
        entry = np.repeat(index.first[n[place]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        window = index.entry_window[entry]
        start = np.repeat(place, count) - index.entry_at[entry]
        fits = (start >= 0) & (start + of.lengths[window] <= len(n))
        start, window = start[fits], window[fits]
        for j in range(of.windows.shape[1]):
            want = of.windows[window, j]
            same = (want < 0) | (n[np.minimum(start + j, len(n) - 1)] == want)
            start, window = start[same], window[same]
        found.append((start, window))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def covered_spans(start: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans (first word, word after the last) that the windows cover together."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), (start + length).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan_column(index: WindowIndex, column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Word counts, covered spans and items of each row."""
    n_words, spans, items = [0] * len(column), [[] for _ in range(len(column))], [[] for _ in range(len(column))]
    for row, h in text_words(column):
        n_words[row] = len(h)
        start, window = find_windows(index, h)
        if len(start):
            of = index.of
            spans[row] = covered_spans(start, of.lengths[window])
            held = [of.item[of.first_item[w] : of.first_item[w + 1]] for w in np.unique(window)]
            items[row] = [of.names[i] for i in np.unique(np.concatenate(held))]
    return n_words, spans, items


def benchmark_blocks(benchmark: DataFrame, *, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, a bounded block at a time. Items without an id or a word are in none."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for b in range(n):
        yield [(r["item"], r["text"]) for r in (rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else rows).collect()]


def make_index(docs: DataFrame, items: list[tuple[str, str | None]], *, text_col: str = "text", width: int = WINDOW) -> WindowIndex:
    of = item_windows(items, width)
    return build_index(of, word_frequencies(docs, of.vocab, text_col))


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))


def _scan(docs: DataFrame, index: WindowIndex) -> DataFrame:
    """(id, text) rows to (id, n_words, spans, items)."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = scan_column(shared.value, batch.column(1))
            cells = [[{"first": a, "after": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cells, kind), pa.array(items, pa.list_(pa.string()))], names=["id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def _hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["after"] - s["first"])


def _merged(spans):
    """Disjoint spans from sorted ones of several blocks."""
    one = F.array().cast(_SPANS)
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["after"], s["after"]).alias("after"))))
    return F.aggregate(F.sort_array(spans), one, lambda acc, s: F.when((F.size(acc) > 0) & (s["first"] <= F.try_element_at(acc, F.lit(-1))["after"]), longer(acc, s)).otherwise(F.concat(acc, F.array(s))))


def _scan_blocks(rows: DataFrame, first: WindowIndex, second: WindowIndex, more: Iterator[WindowIndex]) -> DataFrame:
    """``_scan`` of several blocks over written rows (id, text) of distinct ids: one block's index at a time."""
    union = materialize(_scan(rows, first), "decontam-hits")
    index: WindowIndex | None = second
    while index is not None:  # later blocks add the rows that they hit
        union = union.unionByName(materialize(_scan(rows, index).where(F.size("items") > 0), "decontam-hits"))
        index = next(more, None)
    spans, items = F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    merged = union.groupBy("id").agg(F.max("n_words").alias("n_words"), spans, items)
    return merged.select("id", "n_words", _merged(F.col("spans")).alias("spans"), "items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, n_words, n_hit, spans, items)`` for each row of ``docs``.

    ``spans`` are the runs of words inside windows, ``items`` the ids (as text, sorted) of items
    with a window in the text. Null and empty texts have no words; an empty benchmark hits
    nothing; ids may be null or repeat, each row is judged alone, by a number of its own; other
    columns are not read. Words are compared by 64-bit hashes.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _indexes(narrow, benchmark, item_col, item_text_col, width, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _scan(narrow, first)
    else:
        rows = materialize(narrow.select("id", F.monotonically_increasing_id().alias("rid"), "text"), "decontam-rows")
        merged = _scan_blocks(rows.select(F.col("rid").alias("id"), "text"), first, second, blocks).withColumnRenamed("id", "of")
        found = rows.select("id", "rid").join(merged, F.col("rid") == F.col("of")).select("id", "n_words", "spans", "items")
    return found.select(F.col("id").alias(id_col), "n_words", _hit_words(F.col("spans")).alias("n_hit"), "spans", "items")


def _indexes(narrow: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, width: int, block_bytes: int) -> Iterator[WindowIndex]:
    none = True
    for items in benchmark_blocks(benchmark, item_col=item_col, text_col=item_text_col, block_bytes=block_bytes):
        none = False
        yield make_index(narrow, items, width=width)
    if none:
        yield build_index(item_windows([], width), np.zeros(0, np.int64))


def contaminated(n_hit, n_words):
    """The contract's rule: a twentieth or more of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark drops none
    and an empty table gives no rows. With one block rows pass by it whole; with more they are
    numbered and written, and only the numbers of those that go are joined back.
    """
    row = F.col(PREFIX + "row")
    blocks = _indexes(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text_col, width, block_bytes)
    first, second = next(blocks), next(blocks, None)
    bad = contaminated(_hit_words(F.col("spans")), F.col("n_words"))
    if second is None:
        found = _scan(wrap(docs).select(row.alias("id"), row[text_col].alias("text")), first)
        return found.where(~bad).select(*unwrap(docs.columns, [], "id"))
    rows = materialize(wrap(docs).select(row, F.monotonically_increasing_id().alias("rid")), "decontam-rows")
    found = _scan_blocks(rows.select(F.col("rid").alias("id"), row[text_col].alias("text")), first, second, blocks)
    gone = found.where(bad).select(F.col("id").alias("gone"))
    return rows.join(gone, F.col("rid") == F.col("gone"), "left_anti").select(*unwrap(docs.columns, []))


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
