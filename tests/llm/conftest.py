import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, blanks, one word, controls, symbols, repeats and a long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [
        (None, "a row without an id but with some words"),
        (None, None),
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "one"),
        (5, "same same same same same"),
        (5, "same same same same same"),
        (6, "Größe\x0bnaïve \U0001f600 # * $ % & | < >\nGröße\nGröße\n\n \n"),
        (7, long),
        (8, "no-break\xa0space stays\u2003one word\x1cand this too"),
        (9, "No-Break\xa0Space stays\u2003one word\x1cAND THIS TOO"),
        (10, "line a b c\nline a b c\nother line a b c"),
    ]
