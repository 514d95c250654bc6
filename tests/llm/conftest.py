import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with a source, a language and a clashing column."""

    def make(pairs):
        rows = [(i, t, "en", f"s{(i or 0) % 3}", 7) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty, short, long, repeated and tied rows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    base = " ".join(words)
    return docs_of(
        [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, base.upper()), (5, " \t\n"), (6, "one"),
         (7, " ".join(words * 900)), (8, base + " extra words here"), (9, "é ß ñ"), (10, base.upper())]
    )
