import pytest

#: More columns than the operators ask for, with names that they return themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, kept boolean, component_id long, __text string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, white space, ties, repeated rows, a very long text, other scripts, clashing columns."""
    base = "The quick brown fox jumps over the lazy dog and runs along the river bank until night falls over the quiet village. "
    texts = [None, "", "   \n\t ", "12 34 5", "word", base, base, base * 3, base.upper(), "línea única con eñes y más palabras " * 9, "日本語のテキスト 日本語", "a\n\nb\na\n", "x" * 70_000, base * 900, "\u0000ctl\u0001 text", "###***$$$ %% || <b> & # " * 20]
    rows = [(i, t, None if i % 5 == 0 else "en", "s", len(t or ""), 0.5, 7, True, 1, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5], rows[1]], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
