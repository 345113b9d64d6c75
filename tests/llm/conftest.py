import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows, with the columns of the given one."""

    def documents(rows, n=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)

    return documents
