"""Fixtures and brute-force forms that the tests of the text operators share."""

from __future__ import annotations

import random
import re

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names are those of the operators' own and internal columns.
CLASHING = "shard int, slot string, fp string, id string, rid string, kept string, cell string, label string, __gw_row string"


def lower(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sentence(rng: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, one word, repeated rows, a null id, all kinds of white space."""
    rng = random.Random(1)
    base = sentence(rng, 60)
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n\x0b\x0c\r", "en", "s", 6),
        (4, "One", "en", "s", 3),
        (5, base, "en", "s", 1),
        (5, base, "en", "s", 1),
        (None, base, "de", None, 1),
        (7, base + "\nlast line ÄÖÜ K \U0001f600 café", "de", "s", 2),
        (8, "a b c d e " * 30, "en", "s", 3),
        (9, "Line one here\nLine one here\n\nLine two\n", "en", "s", 4),
        (10, "zwei wörter", None, "t", 5),
    ]


def frame(spark, rows, extra: bool = False):
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, 77, "x", "y", "z", "u", "v", "w", "q", "g") for r in rows], f"{DOCS}, {CLASHING}")


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
