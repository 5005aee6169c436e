"""License scan as an exact set-similarity join, in DataFrame functions only.

Templates are license notices or whole license texts. A text block is a line, or overlapping
windows of a long line, or one of the overlapping windows over the words of the whole text, which
find notices wrapped over lines. In these the words from the first to the last of a line's hit are
left out: they belong to its notice and are no part of another. The join finds every (block,
template) whose shared distinct tokens are at least ``threshold`` of the template's tokens:

* tokens are ordered globally, rarest first, by the number of all texts that hold them;
* prefix filter: a template of m tokens with required overlap o is met only by a block that
  holds one of its m - o + 1 rarest tokens;
* length filter: the block has at least o of the tokens that occur in templates;
* positional filter: where the first shared token stands in both ordered lists leaves at least
  o tokens from there on;
* what is left is verified exactly.

The template side is a bounded table (``MAX_TEMPLATE_TOKENS`` tokens, checked), so it is an
inverted index inside the plan: no text is shuffled, and no source or group of copies can make
a partition hot.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import let

#: Notices of well-known licenses, by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": ("Released under the MIT License", "Permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "apache-2": ("Licensed under the Apache License Version 2.0",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"),
    "gpl-3": ("This work is licensed under the GNU General Public License version 3",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License v. 2.0",),
    "bsd": ("Redistribution and use in source and binary forms with or without modification are permitted",),
    "isc": ("Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: Phrases whose words, standing consecutively, give a label: fixed values of the contract.
PHRASES: dict[str, tuple[str, ...]] = {"mit": ("under", "the", "mit", "license"), "apache-2": ("apache", "license", "version", "2"), "cc-by-nc": ("cc", "by", "nc")}

MAX_TEMPLATE_TOKENS = 4096
BLOCK_WORDS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words, before A-Z are lower-cased and within one class of characters.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def tokens_of(text: str) -> list[str]:
    """The words of a template."""
    return [w for w in re.split(f"[{SEPARATORS}]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def words_of(text: Column) -> Column:
    """The words of a text as they are written; ``lowered`` gives them with A-Z lower-cased."""
    trimmed = F.regexp_replace(text, f"^[{SEPARATORS}]+|[{SEPARATORS}]+\\z", "")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SEPARATORS}]+")).otherwise(F.array().cast("array<string>"))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _any_of(words: list[str]) -> str:
    """A pattern for one of these ASCII words standing alone, in either case."""
    return f"(?i)(?<![^{SEPARATORS}])(?:{'|'.join(map(re.escape, words))})(?![^{SEPARATORS}])"


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def token_order(docs: DataFrame, vocabulary: list[str], *, text_col: str = "text") -> list[str]:
    """The vocabulary, rarest first, by the number of texts in all of ``docs`` that hold each token.

    Only the vocabulary's counts come back, and its size is bounded by the templates. The order
    says which tokens are looked at first; the hits are the same under any order.
    """
    words = F.split(F.lower(F.col(text_col)), f"[{SEPARATORS}]+")
    held = docs.select(F.explode(F.array_intersect(words, _strings(vocabulary))).alias("token"))
    found = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda t: (found.get(t, 0), t))


def _folded(words: Column) -> Column:
    """Words with A-Z lower-cased all at once: they are joined by a blank, which none contains."""
    return F.split(lowered(F.array_join(words, " ")), " ")


def _hits(words: Column, first_word: Column, order: list[str], templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The join of one block (its words, A-Z lower-cased) with the templates."""
    rank = {t: i for i, t in enumerate(order)}
    index = F.create_map(*[F.lit(x) for t, i in rank.items() for x in (t, i)])
    items = []
    for label, tokens in templates:
        ranks = sorted(rank[t] for t in set(tokens))
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        items.append(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, ranks)).alias("ranks"), F.lit(need).alias("need")))

    def verified(block: Column) -> Column:
        def meets(t: Column) -> Column:
            m, need = F.size(t["ranks"]), t["need"]
            shared = F.array_intersect(F.slice(t["ranks"], 1, m - need + 1), block)
            first = F.element_at(shared, 1)  # rarest of the prefix that the block has
            left = F.least(m - F.array_position(t["ranks"], first), F.size(block) - F.array_position(block, first)) + 1
            return (F.size(block) >= need) & (F.size(shared) > 0) & (left >= need) & (F.size(F.array_intersect(t["ranks"], block)) >= need)

        found = F.filter(F.array(*items), meets)
        return F.transform(found, lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(t["ranks"], block)) / F.size(t["ranks"])).alias("containment")))

    ranked = F.sort_array(F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(index, w)), lambda r: r.isNotNull())))
    located = let(ranked, verified)
    # The span of a hit: from the first to the last word of the block that is in the vocabulary.
    marks = F.filter(F.transform(words, lambda w, i: F.when(F.try_element_at(index, w).isNotNull(), i)), lambda i: i.isNotNull())
    return F.transform(located, lambda h: F.struct(h["label"].alias("label"), h["containment"].alias("containment"), (first_word + F.array_min(marks)).cast("long").alias("first_word"), (first_word + F.array_max(marks)).cast("long").alias("last_word")))


_HITS = "array<struct<label:string,containment:double,first_word:bigint,last_word:bigint>>"


def _by_block(templates: list[tuple[str, list[str]]], least: int) -> dict[int, list[tuple[str, list[str]]]]:
    """The templates by the words of the blocks that they are sought in: twice their own at least, in powers of two times ``least``."""
    out: dict[int, list[tuple[str, list[str]]]] = {}
    for label, tokens in templates:
        words = least
        while words < 2 * len(tokens):
            words *= 2
        out.setdefault(words, []).append((label, tokens))
    return dict(sorted(out.items()))


def license_hits(
    docs: DataFrame,
    *,
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    threshold: float = 0.8,
    block_words: int = BLOCK_WORDS,
    order: list[str] | None = None,
) -> Column:
    """The hits of each text: an array of (label, containment, first_word, last_word), words from 0.

    A null or empty text has none. The order comes from all of ``docs`` unless it is given.
    Templates may be whole licence texts: those of more than half of ``block_words`` words are
    sought in blocks of twice, four times ... as many.
    """
    chosen = [(label, tokens_of(t)) for label, texts in (templates or TEMPLATES).items() for t in texts]
    vocabulary = sorted({t for _, tokens in chosen for t in tokens})
    if sum(len(set(t)) for _, t in chosen) > MAX_TEMPLATE_TOKENS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_TOKENS} tokens")
    order = order or token_order(docs, vocabulary, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat(*[_found(text, own, order, threshold, words) for words, own in _by_block(chosen, block_words).items()])


def _found(text: Column, chosen: list[tuple[str, list[str]]], order: list[str], threshold: float, block_words: int) -> Column:
    """The hits of these templates in the blocks of lines, then in those of the whole text."""
    own_tokens = {t for _, tokens in chosen for t in tokens}
    order = [t for t in order if t in own_tokens]
    rank = {t: i for i, t in enumerate(order)}
    prefix: set[str] = set()
    for _, tokens in chosen:
        own = sorted(set(tokens), key=rank.__getitem__)
        prefix |= set(own[: len(own) - max(1, math.ceil(threshold * len(own) - 1e-9)) + 1])
    gate = _any_of(sorted(prefix))
    step = block_words // 2

    def of_line(line: Column) -> Column:
        """line: (first word of the line, its words)."""
        heads = F.sequence(F.lit(0), F.greatest(F.size(line["words"]) - step - 1, F.lit(0)), F.lit(step))
        block = lambda h: F.slice(line["words"], h + 1, block_words)
        return F.flatten(F.transform(heads, lambda h: _hits(block(h), line["at"] + h, order, chosen, threshold)))

    def of_text(lines: Column) -> Column:
        """lines: (passes the gate, words) of each line; the first word of each is a running count."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<int>").alias("near"))
        window = lambda word: F.floor(word / step).cast("int")
        near = lambda acc, x: F.sequence(F.greatest(window(acc["at"]) - 1, F.lit(0)), window(acc["at"] + F.size(x["words"])))
        hits = lambda acc, x: of_line(F.struct(acc["at"].alias("at"), _folded(x["words"]).alias("words")))
        step_on = lambda acc, x: F.struct(
            (acc["at"] + F.size(x["words"])).alias("at"),
            F.when(x["open"], F.concat(acc["hits"], hits(acc, x))).otherwise(acc["hits"]).alias("hits"),
            F.when(x["open"], F.array_union(acc["near"], near(acc, x))).otherwise(acc["near"]).alias("near"),
        )
        with_windows = lambda acc: F.when(F.size(lines) > 1, F.concat(acc["hits"], across(lines, acc))).otherwise(acc["hits"])
        return let(F.aggregate(lines, start, step_on), with_windows)

    def across(lines: Column, acc: Column) -> Column:
        """Hits of the windows of the whole text that touch a line which passes the gate, without the words of the lines' hits."""
        last = F.floor(F.greatest(acc["at"] - step - 1, F.lit(0)) / step)
        taken = lambda place: F.exists(acc["hits"], lambda y: (y["first_word"] <= place) & (place <= y["last_word"]))
        free = lambda words, at: F.transform(words, lambda w, i: F.when(taken(at + i), "").otherwise(w))
        block = lambda words, h: _folded(free(F.slice(words, h * step + 1, block_words), h * step))
        heads = F.filter(acc["near"], lambda h: h <= last)
        of_windows = lambda words: F.flatten(F.transform(heads, lambda h: _hits(block(words, h), h * step, order, chosen, threshold)))
        return let(F.flatten(lines["words"]), of_windows)

    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.rlike(gate).alias("open"), words_of(x).alias("words")))
    return F.when(text.rlike(gate), let(lines, of_text)).otherwise(F.array().cast(_HITS))


def phrase_places(text: Column) -> Column:
    """All places of the contract's phrases: an array of (label, at), words from 0."""
    sep = f"[{SEPARATORS}]+"
    gate = "(?i)(?<![^" + SEPARATORS + "])(?:" + "|".join(sep.join(p) for p in PHRASES.values()) + ")(?![^" + SEPARATORS + "])"
    none = F.array().cast("array<struct<label:string,at:bigint>>")

    def places(words: Column) -> Column:
        at = lambda p: F.filter(F.transform(words, lambda w, i: F.when((w == p[0]) & F.coalesce(F.slice(words, i + 1, len(p)) == _strings(list(p)), F.lit(False)), i.cast("long"))), lambda i: i.isNotNull())
        named = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.alias("at"))
        return F.concat(*[F.transform(at(p), named(label)) for label, p in PHRASES.items()])

    return F.when(text.rlike(gate), let(_folded(words_of(text)), places)).otherwise(none)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row ``(id, n_words, phrases, hits)`` for each row of ``docs``.

    Null and empty texts have 0 words and no hits; ids may be null or repeat; ties and repeated
    rows give equal rows; other columns are not read.
    """
    hits = license_hits(docs, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias(id_col), F.size(words_of(text)).cast("long").alias("n_words"), phrase_places(text).alias("phrases"), hits.alias("hits"))
