import random

import public_tokenizers
import pytest

from gatewright.llm import token_counts

from .helpers import frame, odd_rows, sentence


def texts_():
    rng = random.Random(15)
    glyphs = ["é", "ß", " ", "　", "日本語", "\U0001f600", "<|endoftext|>", "'s", "  ", "\t", "\n\n", "3", "12", "$", "don't", " ", "\x1c", "\x85"]
    out = [sentence(rng, 40) for _ in range(5)]
    for _ in range(150):
        out.append("".join(rng.choice([" ", "", "\n"]) + (rng.choice(glyphs) if rng.random() < 0.4 else f"w{rng.randrange(999)}") for _ in range(rng.randrange(80))))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    rows = odd_rows() + [(3000 + i, t, "en", "s", 0) for i, t in enumerate(texts_())] + [(4000, " ".join(texts_()), "en", "s", 0)]
    want = sorted(((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows), key=repr)
    for batch_bytes in (64, 1 << 18):
        got = token_counts.token_counts(frame(spark, rows, extra=True), lambda: public_tokenizers.path(name), batch_bytes=batch_bytes).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_cuts_are_safe():
    count, can_cut = token_counts.load_counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert can_cut and not token_counts.load_counter(public_tokenizers.path("word_bpe_49k.json"))[1]
    for text in texts_():
        for limit in (1, 7, 30):
            parts = token_counts.cut_long(text, limit)
            assert "".join(parts) == text and sum(count(parts)) == count([text])[0]


def test_empty_table_and_unknown_file(spark):
    assert token_counts.token_counts(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    with pytest.raises(ValueError):
        token_counts.load_counter("x.bin")
