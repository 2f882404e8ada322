import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table of texts, or of (doc_id, text) pairs."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(i, t, "en", f"src{i % 3}" if i is not None else None, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
