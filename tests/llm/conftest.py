import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, label int, fp string, cell string, hits__ int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, source]) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1, "y", "z", 3) for r in rows], SCHEMA)

    return make
