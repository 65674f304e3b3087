import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A table like documents, with further columns whose names clash with what operators add."""

    def table(rows):
        out = spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or "")) for r in rows], DOCUMENTS)
        more = ["1 AS score", "2 AS k", "3 AS v", "4 AS t", "5 AS r", "'x' AS held_out", "6 AS key", "7 AS root", "8 AS sig", "9 AS ids", "10 AS size"]
        return out.selectExpr("*", *more)

    return table


ODD = [
    (1, "", "en", "a"),
    (2, None, "en", "a"),
    (3, "   ", None, None),
    (4, "one", "de", "b"),
    (5, "one", "de", "b"),
    (5, "one", "de", "b"),
    (None, "no id but words, several words in a row", "en", None),
    (None, None, None, None),
    (7, "é" * 3000 + "\n\t  ▁x \U0001f600", "fr", "b"),
    (8, "word " * 20000, "en", "c"),
    (9, "1 " * 5000 + "+" * 2000 + "(" * 2000 + "9" * 3000, "en", "c"),
    (10, "a" * 60000, None, "c"),
    (11, "nul \x00\x00 bytes", "en", "c"),
    (-3, "Plain text with a few more words than five in it.", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([(1, "x")]).where("false")
