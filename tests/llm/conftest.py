"""Helpers for the operators of the llm package."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, chunk string, task int, kept string, lang_pred string, score int, n_words string"
#: Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns whose names operators use inside.
ODD = [
    (1, None, "en", "a", None, "x", 1), (2, "", "en", None, 0, None, None), (3, " \t\n ", None, "a", 4, "x", 1), (4, "one", "en", "a", 3, "x", 1), (5, "one", "en", "a", 3, "x", 1), (5, "one", "en", "a", 3, "x", 1),
    (None, "no id here", "en", "a", 10, "x", 1), (6, "12345 !!! ...", "de", "a", 13, "x", 1), (7, "dağ 日本語 🎉 ünï code\x1c words", "xx", "a", 25, "x", 1), (8, "word " * 60_000, "en", "a", 300_000, "x", 1), (9, "a" * 20_000, "en", "a", 20_000, "x", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*row, "k", "l", 7, "n") for row in ODD], DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def texts(spark, sf):
    from inkstream.session import table

    return [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, sf, "documents").collect()]
