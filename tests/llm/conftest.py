import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node int, kept string, spans string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (id, text), with extra columns whose names clash with results."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y", "z") for i, t in rows], DOCS)

    return build


#: Nulls, empties, repeats, odd characters and lengths.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "no id here"), (5, "word " * 20000), (6, "x" * 70000), (7, "é日本\U0001f600 ñ " * 50), (8, "<|endoftext|> hi"),
    (9, "tab\tnew\nline  two   three"), (10, "\x00\x01\x1c\x85\xa0"), (11, "A.b@c.de +1 (415) 555-1212 4111 1111 1111 1111 10.0.0.256 10.0.0.1"), (12, "İΣς ǅ ﬁ ½"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def empty(make):
    return make([(1, "x")]).where("false")
