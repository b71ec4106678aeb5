from __future__ import annotations

import random

import pytest

from tidemark.llm.session import tune_text

TOKENIZER = "word_bpe_49k.json"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def text_spark(spark):
    return tune_text(spark)


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n)]


@pytest.fixture
def frame(text_spark):
    """Documents from (id, text[, lang, source]) tuples."""

    def make(rows):
        full = [(i, t, *rest, *[None] * (2 - len(rest)), None if t is None else len(t)) for i, t, *rest in rows]
        return text_spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(text_spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(5)
    long_text = " ".join(words(rng, 30_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 3), (1, "one two three four five six seven", "en", "a", 3),
        (2, "ONE two three four five six seven", "en", "a", None), (3, None, "en", None, None), (None, "one two three four five six seven", None, "b", 1),
        (None, None, None, None, None), (None, None, None, None, None), (4, "", "de", "b", 0), (5, " \n\t ", "de", "b", 3), (6, "?! ... 12", None, "b", 9),
        (7, long_text, "fr", "a", 1), (8, "x" * 200_000, "fr", "a", 1), (9, "one", "en", "", 1), (10, "é́  İ <|endoftext|> \x1cstop", "en", "c", 2),
        (1, "another text under the same id", "en", "a", 3), (-4, "negative ids are ids", "en", "a", 3),
    ]
    own = "key row at nth digest name size labels node label task chunk block slot start deal id no_id print kept score copies".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in own)
    return text_spark.createDataFrame([(*r, *[f"{k}" for k in range(len(own))]) for r in rows], schema)
