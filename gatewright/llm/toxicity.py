"""Toxicity by multiple-instance learning.

Only documents have labels. A sentence's score is a logistic function of the words in it, and
a document is toxic if any of its sentences is: sentence scores are combined by noisy-or,
P(document) = 1 - prod(1 - p(sentence)). The weights are trained through that combination, so
the labels of documents teach which sentences offend, and these are then located.

The features of a word are itself and its first few bytes, at several lengths below its own, so
that a form which was not seen in training is known by its stem.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, PUNCT, PUNCT_RAW, Piece, mix, pieces, word_hashes, words
from .scratch import drawn, materialize

#: Bytes that end a sentence.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


#: Bytes of the stems of longer words.
STEMS = (4, 5, 6, 7, 8, 9)


@dataclass
class ToxicModel:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float


def sentences(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sentence of each byte, numbered through the piece; each text starts a new one."""
    step = np.zeros(len(data), np.int64)
    step[1:] = ENDS[data[:-1]]
    step[bounds[:-1][bounds[:-1] < bounds[1:]]] = 1
    return np.cumsum(step)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their feature hashes) for the words themselves and for each length of stem."""
    yield np.arange(len(starts)), word_hashes(data, starts, ends)
    for k in STEMS:
        longer = np.flatnonzero(ends - starts > k)
        yield longer, mix(word_hashes(data, starts[longer], starts[longer] + k) + np.uint64(k))


def _parsed(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and the sentence of each byte."""
    data = LOWER[p.data]
    starts, ends = words(data, p.bounds, PUNCT)
    return data, starts, ends, sentences(data, p.bounds)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, label, text) batches to (feature, documents with it, toxic ones of them)."""
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), np.int64)
        found: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for p in pieces(batch.column(2), separators=PUNCT_RAW):
            data, starts, ends, _ = _parsed(p)
            row = p.rows[np.searchsorted(p.bounds, starts, "right") - 1] if len(starts) else starts
            for which, h in word_features(data, starts, ends):
                found.append(h)
                rows.append(row[which])
            if len(found) > 200 and not p.cut:
                yield from _summed(np.concatenate(found), np.concatenate(rows), labels)
                found, rows = [], []
        if found:
            yield from _summed(np.concatenate(found), np.concatenate(rows), labels)


def _summed(h: np.ndarray, row: np.ndarray, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    once = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    h, toxic = h[once], labels[row[once]]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if len(h):
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h)))), pa.array(np.add.reduceat(toxic, first))], names=["feature", "n", "toxic"])


def _instances(features: np.ndarray):
    """(row, label, text) batches to (row, label, sentences, the chosen features and their sentences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for p in pieces(batch.column(2), separators=ENDS):
                data, starts, ends, sent = _parsed(p)
                at = [which_hit(features, h, which) for which, h in word_features(data, starts, ends)]
                word, hit = (np.concatenate([x[i] for x in at]) for i in (0, 1))
                order = np.argsort(word, kind="stable")
                word, hit = word[order], hit[order]
                cut = np.searchsorted(starts[word], p.bounds)
                for k, row in enumerate(p.rows):
                    a, b = p.bounds[k], p.bounds[k + 1]
                    own = slice(cut[k], cut[k + 1])
                    first = int(sent[a]) if b > a else 0
                    n = int(sent[b - 1]) - first + 1 if b > a else 0
                    yield pa.RecordBatch.from_arrays([pa.array([keys[row]], pa.int64()), pa.array([labels[row]], pa.int32()), pa.array([n], pa.int32()), pa.array([hit[own]], pa.list_(pa.int64())), pa.array([sent[starts[word[own]]] - first], pa.list_(pa.int64()))], names=["row", "label", "n_sents", "hits", "sents"])

    return run


def which_hit(features: np.ndarray, h: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that have a chosen feature, and its number."""
    if not len(features) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(features, h), len(features) - 1)
    hit = features[at] == h
    return which[hit], at[hit]


def choose_features(counts: DataFrame, n_docs: int, n_toxic: int, *, max_features: int = 256, min_docs: int = 4) -> np.ndarray:
    """The features in at least ``min_docs`` documents that tell the labels apart best (chi-square)."""
    share = n_toxic / n_docs
    n = F.col("n").cast("double")
    expected = n * share
    spread = F.greatest(expected * (1 - share) * (1 - n / n_docs), F.lit(1e-9))
    chi = F.pow(F.col("toxic") - expected, 2) / spread
    top = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= min_docs).select("feature", chi.alias("chi")).where("chi > 15").orderBy(F.desc("chi"), "feature").limit(max_features)
    return np.sort(np.array([r["feature"] for r in top.collect()], np.int64).view(np.uint64))


def train_noisy_or(features: np.ndarray, docs: list[tuple[int, float, int, np.ndarray, np.ndarray]], *, rounds: int = 250, rate: float = 0.1, decay: float = 1e-3) -> ToxicModel:
    """Fit weights to (label, weight, sentences, feature numbers, sentence of each) of documents."""
    width = max(len(features), 1)
    y, weight = np.array([d[0] for d in docs], float), np.array([d[1] for d in docs], float)
    n_sents = np.array([max(d[2], 1) for d in docs])
    base = np.concatenate([[0], np.cumsum(n_sents)])
    cells = np.unique(np.concatenate([(d[4] + b) * width + d[3] for d, b in zip(docs, base, strict=False)]).astype(np.int64))
    row, col = cells // width, cells % width
    doc_of = np.repeat(np.arange(len(docs)), n_sents)
    w, b = np.zeros(width), -4.0
    m, s = np.zeros(width + 1), np.zeros(width + 1)
    scale = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[col], minlength=base[-1])
        sigma = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        log_clean = np.bincount(doc_of, weights=-np.logaddexp(0, z), minlength=len(docs))
        clean = np.exp(np.minimum(log_clean, -1e-9))
        outer = scale * np.where(y > 0, -clean / (1 - clean), 1.0)
        g = outer[doc_of] * sigma
        grad = np.append(np.bincount(col, weights=g[row], minlength=width) + decay * w / len(docs), g.sum())
        m = 0.9 * m + 0.1 * grad
        s = 0.99 * s + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
        w, b = w - step[:-1], b - step[-1]
    return ToxicModel(features, w[: len(features)], float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: Column | None = None, max_docs_per_class: int = 3000) -> ToxicModel:
    """Fit on documents that ``labels`` marks 0 or 1 and for whose id ``train`` holds.

    The classifier is fitted on a bounded sample: about ``max_docs_per_class`` documents of each
    class, chosen by a hash of the id; a class's weight makes up for its sampling. An id with
    several labels counts as toxic if any says so. Null ids, texts and labels teach nothing, and
    without both classes the score of all texts is the training share of toxic ones.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    if train is not None:
        marked = marked.withColumnRenamed("id", id_col).where(train).withColumnRenamed(id_col, "id")
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = 1 - 1e-3 if counts.get(1) else 1e-3
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    shares = {k: min(1.0, max_docs_per_class / n) for k, n in counts.items()}
    chosen = F.when(F.col("label") == 1, drawn(9, F.col("id"), shares[1])).otherwise(drawn(9, F.col("id"), shares[0]))
    # The drawn ids are bounded by the two class sizes, so they may be broadcast.
    sample_ids = F.broadcast(marked.where(chosen).select("id", "label"))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(sample_ids, "id")
    # Written once: a bounded table that both passes over the sample read.
    sample = materialize(found.select(F.monotonically_increasing_id().alias("row"), "label", "text"), "toxicity-sample")
    n_docs, n_toxic = sample.agg(F.count("*"), F.sum("label")).first()
    if not n_docs or n_toxic in (0, n_docs):
        share = min(max((n_toxic or 0) / max(n_docs, 1), 1e-3), 1 - 1e-3)
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    features = choose_features(sample.mapInArrow(_feature_counts, "feature long, n long, toxic long"), n_docs, n_toxic)
    table = sample.mapInArrow(_instances(features), "row long, label int, n_sents int, hits array<long>, sents array<long>").toArrow()
    merged: dict[int, list] = {}
    for row, label, n, hits, sents in zip(*[table.column(c).to_pylist() for c in ("row", "label", "n_sents", "hits", "sents")], strict=True):
        doc = merged.setdefault(row, [label, 1 / shares[label], 0, [], []])
        doc[3] += hits
        doc[4] += [s + doc[2] for s in sents]
        doc[2] += n
    return train_noisy_or(features, [(d[0], d[1], d[2], np.array(d[3], np.int64), np.array(d[4], np.int64)) for _, d in sorted(merged.items())])


def _spans(model: ToxicModel, piece, data: np.ndarray, sent: np.ndarray, z_of: np.ndarray, first_char: int, least: float) -> list[list[tuple[int, int, float]]]:
    """For each text of a piece, the character spans of its sentences that score at least ``least``."""
    found: list[list[tuple[int, int, float]]] = [[] for _ in piece.rows]
    hot = np.flatnonzero(z_of >= np.log(least / (1 - least)))
    if len(hot):
        lo, hi = np.searchsorted(sent, hot, "left"), np.searchsorted(sent, hot, "right")
        for k, a, b in zip(np.searchsorted(piece.bounds, lo, "right") - 1, lo, hi, strict=True):
            chars = np.cumsum((data[piece.bounds[k] : b] & 0xC0) != 0x80)
            start = int(chars[a - piece.bounds[k] - 1]) if a > piece.bounds[k] else 0
            z = float(z_of[sent[a]])
            found[k].append(((first_char if k == 0 else 0) + start, (first_char if k == 0 else 0) + int(chars[-1]), 1 / (1 + np.exp(-z))))
    return found


def score_toxicity(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row ``(id, score, offending)`` for each row of ``docs``.

    ``offending`` lists ``(start, end, p)`` of the sentences with p of ``least`` or more, in
    characters of the text. An empty or null text has one empty sentence. Ids may be null or
    repeat; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicModel = shared.value
        none = -float(np.logaddexp(0, m.bias))
        for batch in batches:
            log_clean, spans, chars = np.full(len(batch), np.nan), [[] for _ in range(len(batch))], 0
            for p in pieces(batch.column(1), separators=ENDS):
                if not len(p.data):
                    continue
                data, starts, ends, sent = _parsed(p)
                at = [which_hit(m.features, h, which) for which, h in word_features(data, starts, ends)]
                cell = np.unique(np.concatenate([sent[starts[word]] * max(len(m.features), 1) + hit for word, hit in at]))
                n = int(sent[-1]) + 1
                z = m.bias + np.bincount(cell // max(len(m.features), 1), weights=m.weights[cell % max(len(m.features), 1)], minlength=n) if len(cell) else np.full(n, m.bias)
                full = np.flatnonzero(np.diff(p.bounds) > 0)
                # The first byte of a piece has sentence 1 if it starts a text, else 0 likewise.
                firsts = sent[p.bounds[:-1][full]]
                lasts = sent[p.bounds[1:][full] - 1]
                sums = np.concatenate([[0], np.cumsum(-np.logaddexp(0, z))])
                log_clean[p.rows[full]] = np.where(np.isnan(log_clean[p.rows[full]]), 0, log_clean[p.rows[full]]) + sums[lasts + 1] - sums[firsts]
                if not p.goes_on:
                    chars = 0
                z[: int(sent[0])] = -np.inf
                for row, found in zip(p.rows, _spans(m, p, data, sent, z, chars, least), strict=True):
                    spans[row] += found
                chars += int(((p.data & 0xC0) != 0x80).sum())
            log_clean = np.where(np.isnan(log_clean), none, log_clean)
            cells = [[{"start": a, "end": b, "p": q} for a, b, q in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(-np.expm1(log_clean), pa.float64()), pa.array(cells, arrow_span)], names=["id", "score", "offending"])

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
