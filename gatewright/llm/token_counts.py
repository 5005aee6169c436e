"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths come back.

Batches are balanced by bytes, not by rows. A long text is cut at places where the
pre-tokenizer starts a new token whatever stands around it, so a cut changes no count.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A white-space character after a letter or digit: byte-level pre-tokenizers never join the two.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n][A-Za-z0-9])")


def _can_cut(spec: dict) -> bool:
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and spec.get("normalizer") is None
        and not any(a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in added)
    )


def load_counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether long texts may be cut for it."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            raw = f.read()
        tok = Tokenizer.from_str(raw)
        tok.no_truncation()
        tok.no_padding()
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        return lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)], _can_cut(json.loads(raw))
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], False
    raise ValueError(f"no library is known for {path}")


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def cut_long(text: str, limit: int) -> list[str]:
    """``text`` in parts of about ``limit`` characters, cut at safe places only."""
    parts, at = [], 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


def count_batches(texts: list[str | None], count: Callable[[list[str]], list[int]], can_cut: bool, batch_bytes: int) -> list[int]:
    """Token counts of ``texts``, encoding at most about ``batch_bytes`` bytes at a time."""
    totals, waiting, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        nonlocal held
        for i, n in zip(owners, count(waiting), strict=True):
            totals[i] += n
        waiting.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        text = text or ""
        size = _bytes(text)
        # A long text is cut by characters, as many as take the bytes on its average.
        for part in cut_long(text, max(1, batch_bytes * len(text) // size)) if can_cut and size > batch_bytes else [text]:
            n = _bytes(part)
            if held and held + n > batch_bytes:
                flush()
            waiting.append(part)
            owners.append(i)
            held += n
    if waiting:
        flush()
    return totals


def token_counts(docs: DataFrame, tokenizer: str | Callable[[], str], *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """One row ``(id, n_bytes, n_tokens)`` for each row of ``docs``.

    ``tokenizer`` is the path of a tokenizer file on the workers, or a function that gives it
    there. A null text counts as empty (0, 0); ids may be null or repeat, each row is counted on
    its own; an empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or load_counter(tokenizer() if callable(tokenizer) else tokenizer)
            ids, texts = batch.column(0), batch.column(1)
            n_bytes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
            totals: list[int] = []
            for at in range(0, len(texts), 256):  # Python strings of few rows at a time
                totals += count_batches(texts.slice(at, 256).to_pylist(), *counter, batch_bytes)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(totals, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  (bound as pa.compute in the workers)

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
