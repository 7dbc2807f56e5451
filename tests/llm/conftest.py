import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with results."""

    def of(rows):
        full = [(i, t, "en", "s", len(t or ""), 7, 9) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", n_words long, kept long").repartition(3)

    return of


@pytest.fixture(scope="session")
def words():
    """n different invented words, from a number on."""
    return lambda n, start=0: " ".join(f"w{start + i}x" for i in range(n))


#: Null, empty, blank, one word, odd characters.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "é 漢字 x \x1cy"), (None, "no id here")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
