"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts holds the counts of the byte that
follows. Its statistics are frozen after fitting: a byte's probability under a context is its
count against total plus distinct, the escape mass (distinct against the same) goes to the
shorter context over the bytes not seen in the longer one, and the shortest falls back to all
256 bytes evenly. So each language gives a text an exact code length, and the shortest wins.

Frozen trees are compiled to one table: a row for each context, a column for each byte class,
a code length for each language. Bytes that no training text has behave alike in every context
and share one class, so the table is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import column_bytes, pieces
from .scratch import draw_below, draw_of, materialize

#: What stands before the first byte of a text.
PAD = 32
#: The languages whose code lengths are looked up together.
LANGUAGES_AT_ONCE = 16
#: Bytes of the tables of one model, which is broadcast.
MODEL_BYTES = 1 << 29


@dataclass
class PpmModel:
    languages: list[str]
    classes: np.ndarray  # byte -> class
    row_of: np.ndarray  # three classes -> row of bits
    bits: np.ndarray  # (rows * classes, languages) float32
    n_classes: int


def _padded(data: np.ndarray, bounds: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with three bytes of context before each, and where each then starts."""
    lengths = np.diff(bounds)
    starts = bounds[:-1] + 3 * np.arange(1, len(bounds))
    out = np.empty(len(data) + 3 * len(lengths), data.dtype)
    for k in range(3):
        out[starts - 3 + k] = before[:, k]
    out[np.arange(len(data)) + np.repeat(3 * np.arange(1, len(bounds)), lengths)] = data
    return out, starts


def _piece_bytes(column: pa.Array):
    """Pieces of a column with the three bytes that stand before each text of the piece."""
    tail = np.full(3, PAD, np.uint8)
    for p in pieces(column):
        before = np.full((len(p.rows), 3), PAD, np.uint8)
        if p.goes_on:
            before[0] = tail
        padded, starts = _padded(p.data, p.bounds, before)
        tail = padded[-3:].copy()
        yield p, padded, starts


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, four bytes as a number, count)."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for p, padded, starts in _piece_bytes(batch.column(1)):
            b = padded.astype(np.uint32)
            gram = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:] if len(b) > 3 else b[:0]
            here = np.array([langs[i] for i in p.rows], object)
            for lang in set(here):
                keep = np.zeros(len(gram), bool)
                for i in np.flatnonzero(here == lang):
                    keep[starts[i] - 3 : starts[i] - 3 + (p.bounds[i + 1] - p.bounds[i])] = True
                values, n = np.unique(gram[keep], return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def compile_model(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, deep: np.ndarray) -> PpmModel:
    """The code length table of the trees that the counts of four-byte strings describe.

    ``deep`` says of each string whether its three bytes of context have statistics of their own.
    """
    quad = np.stack([(gram >> s) & 255 for s in (24, 16, 8, 0)], axis=1)
    seen = np.unique(np.append(quad[n > 0].ravel(), PAD))
    a, other = len(seen) + 1, len(seen)
    classes = np.full(256, other, np.int32)
    classes[seen] = np.arange(len(seen))
    width = np.ones(a)
    width[other] = 256 - len(seen)
    q = classes[quad]
    c3 = (q[:, 0] * a + q[:, 1]) * a + q[:, 2]
    kept = np.unique(c3[deep])
    row_of = (np.arange(a**3) % (a * a)).astype(np.int32)
    row_of[kept] = a * a + np.arange(len(kept))
    bits = np.empty(((a * a + len(kept)) * a, len(languages)), np.float32)

    def blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities under contexts with these counts, escaping to the shorter contexts' ones."""
        total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        unseen = np.where(counts > 0, 0, shorter)
        left = unseen.sum(1, keepdims=True)
        escape = np.where(left > 0, distinct / np.maximum(total + distinct, 1), 0)
        own = np.where(total > 0, counts / np.maximum(total, 1), 0)
        return np.where(total > 0, (1 - escape) * own + escape * unseen / np.where(left > 0, left, 1), shorter)

    for k in range(len(languages)):
        m = lang == k
        cube = np.zeros((a, a, a))
        np.add.at(cube, (q[m, 1], q[m, 2], q[m, 3]), n[m])
        p0 = blend(cube.sum((0, 1))[None, :], width[None, :] / 256)
        p1 = blend(cube.sum(0), np.broadcast_to(p0, (a, a)))
        p2 = blend(cube.reshape(a * a, a), np.tile(p1, (a, 1)))
        at = np.searchsorted(kept, c3[m])
        there = at < len(kept)
        there[there] = kept[at[there]] == c3[m][there]
        own = np.zeros((len(kept), a))
        np.add.at(own, (at[there], q[m, 3][there]), n[m][there])
        p3 = blend(own, p2[kept % (a * a)])
        bits[:, k] = -np.log2(np.concatenate([p2, p3]) / width).ravel()
    return PpmModel(languages, classes, row_of, bits, a)


def code_lengths(model: PpmModel, column: pa.Array) -> np.ndarray:
    """Bits of each text under each language's tree."""
    out = np.zeros((len(column), len(model.languages)))
    a = model.n_classes
    for p, padded, starts in _piece_bytes(column):
        if not len(p.data):
            continue
        c = model.classes[padded]
        flat = model.row_of[(c[:-3] * a + c[1:-2]) * a + c[2:-1]] * a + c[3:]
        full = np.flatnonzero(np.diff(p.bounds) > 0)
        first = starts[full] - 3
        ends = first + np.diff(p.bounds)[full]
        edges = np.stack([first, ends], axis=1).ravel()
        if edges[-1] == len(flat):
            edges = edges[:-1]
        for k in range(0, len(model.languages), LANGUAGES_AT_ONCE):  # bounds the memory
            bits = model.bits[:, k : k + LANGUAGES_AT_ONCE][flat]
            np.add.at(out[:, k : k + LANGUAGES_AT_ONCE], p.rows[full], np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2])
    return out


def packed_languages(sizes: list[tuple[str, int]], n_bytes: int, model_bytes: int) -> list[list[str]]:
    """Languages in runs whose tables take at most ``model_bytes``, each run one language at least.

    ``sizes`` has the contexts of each language, ``n_bytes`` is the number of different bytes.
    """
    out: list[list[str]] = []
    held, a = 0, n_bytes + 2
    for name, contexts in sorted(sizes):
        if not out or 4 * a * (a * a + held + contexts) * (len(out[-1]) + 1) > model_bytes:
            out.append([])
            held = 0
        out[-1].append(name)
        held += contexts
    return out


def fit_ppm(
    train: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_col: Column | None = None,
    max_docs_per_language: int = 2000,
    min_context: int = 4,
    model_bytes: int = MODEL_BYTES,
) -> PpmModel | list[Callable[[], PpmModel]] | None:
    """Fit the trees on rows that have a text and a language; None if there are none.

    The classifier is fitted on a bounded sample: about ``max_docs_per_language`` whole texts of
    each language, chosen by a hash of ``sample_col`` (the text itself by default). Every language
    is learned; contexts of three bytes that are seen fewer than ``min_context`` times in all are
    left to the shorter ones. Languages whose tables together would take more than ``model_bytes``
    are several models, each compiled when it is asked for.
    """
    key = F.col(text_col) if sample_col is None else sample_col
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw_of(7, key).alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").count().collect()  # a row a language
    if not found:
        return None
    share = F.try_element_at(F.create_map(*[F.lit(x) for r in found for x in (r["lang"], draw_below(max_docs_per_language / r["count"]))]), F.col("lang"))
    counted = rows.where(F.col("draw") < share).select("lang", "text").mapInArrow(gram_counts, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    context = F.shiftright("gram", 8)
    deep = F.sum("n").over(Window.partitionBy(context)) >= min_context
    table = materialize(summed.select("lang", "gram", "n", deep.alias("deep")), "ppm-counts")
    sizes = table.groupBy("lang").agg(F.countDistinct(F.when(F.col("deep"), context)).alias("contexts")).collect()
    if not sizes:
        return None
    n_bytes = table.agg(F.countDistinct(F.col("gram").bitwiseAND(F.lit(255)))).collect()[0][0]
    runs = packed_languages([(r["lang"], r["contexts"]) for r in sizes], n_bytes, model_bytes)

    def compiled(names: list[str]) -> PpmModel:
        own = table.where(F.col("lang").isin(names)).toArrow()
        codes = own.column("lang").combine_chunks().dictionary_encode()
        index = {x: i for i, x in enumerate(names)}
        lang = np.array([index[x] for x in codes.dictionary.to_pylist()])[codes.indices.to_numpy()]
        return compile_model(names, lang, *[own.column(c).to_numpy() for c in ("gram", "n", "deep")])

    return compiled(runs[0]) if len(runs) == 1 else [partial(compiled, names) for names in runs]


def _best_of(column: pa.Array, model: PpmModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the best language of a model, its bits, and the sum of all probabilities by its own."""
    bits = code_lengths(model, column)
    best = bits.argmin(1) if len(bits) else np.zeros(0, int)
    least = bits[np.arange(len(bits)), best]
    return [model.languages[b] for b in best], least, np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)


def _scored(rows: DataFrame, model: PpmModel) -> DataFrame:
    """(id, lang, bits, total, n_bytes) of rows (id, text) under one model; lang is null for a text without a letter."""
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("lang", T.StringType()),
            *[T.StructField(x, T.DoubleType()) for x in ("bits", "total")],
            T.StructField("n_bytes", T.LongType()),
        ]
    )
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of model_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            lettered = [x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()]
            names, bits, total = _best_of(texts, shared.value)
            lang = pa.array([x if ok else None for x, ok in zip(names, lettered, strict=True)], pa.string())
            n = np.diff(column_bytes(texts)[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(bits, pa.float64()), pa.array(total, pa.float64()), pa.array(n)], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, model: PpmModel | list[Callable[[], PpmModel]] | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id, lang_pred, score, bits_per_byte)`` for each row of ``docs``.

    ``score`` is the winner's share of the probability that all languages give the text. A text
    that is null or has no letter is ``und`` with score 0, as is every text if ``model`` is None.
    Ids may be null or repeat; ties go to the first language by name; other columns are not read.
    With several models all texts pass by each in turn.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        none = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte")]
        return narrow.select(F.col("id").alias(id_col), *none)
    if isinstance(model, PpmModel):
        found = _scored(narrow, model)
    else:
        numbered = materialize(narrow.select(F.struct("id", F.monotonically_increasing_id().alias("rid")).alias("id"), "text"), "ppm-rows")
        parts = [materialize(_scored(numbered, m()), "ppm-scored") for m in model]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        each = union.groupBy("id").agg(F.min(F.struct("bits", "lang")).alias("best"), F.collect_list(F.struct("bits", "total")).alias("all"), F.max("n_bytes").alias("n_bytes"))
        gap = lambda x: F.least(x["bits"] - F.col("best.bits"), F.lit(1000.0))
        total = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["total"] * F.pow(F.lit(2.0), -gap(x)))
        found = each.select(F.col("id.id").alias("id"), "best.lang", "best.bits", total.alias("total"), "n_bytes")
    known = F.col("lang").isNotNull()
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("lang", F.lit("und")).alias("lang_pred"),
        F.when(known, 1 / F.col("total")).otherwise(0.0).alias("score"),
        F.when(known, F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
