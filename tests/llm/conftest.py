import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, line string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every odd case, and columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en" if lang is None else lang, "s", len(t or ""), "x", "y", "z") for i, t, lang in ((*r, None)[:3] for r in rows)]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    words = " ".join(f"w{i % 977} and, der" for i in range(20_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, words), (6, "The cat\nsat. <|endoftext|> éé ß漢字 ½"), (7, "The cat\nsat. <|endoftext|> éé ß漢字 ½"), (8, "!!! ###"), (8, "!!! ###"), (9, "a\x1cb​ c\r\n\r\nd  e")]
