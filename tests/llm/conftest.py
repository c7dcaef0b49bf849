import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, fp long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, ids 0, 1, ..., with extra columns whose names the operators use themselves."""

    def build(texts, first=0, ids=None):
        ids = ids or range(first, first + len(texts))
        rows = [(i, t, "en", "src0", len(t or ""), 0.25, "x", 7) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return build


# Null, empty, blank, one character, symbols only, letters beyond the basic plane, a repeated row's text, very long.
AWKWARD = [None, "", " \t\n", "x", "*** ###", "\U0001f600 \U00020000 á", "same text here", "same text here", "word " * 60_000]


@pytest.fixture(scope="session")
def awkward(make_docs):
    return make_docs(AWKWARD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
