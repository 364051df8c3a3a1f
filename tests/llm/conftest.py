import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) or (doc_id, text, source) as a documents table."""
    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) + tuple(r[3:]) for r in rows]
        return spark.createDataFrame(full, DOCS + extra)
    return make


@pytest.fixture(scope="session")
def sample(spark):
    """Texts of the smallest corpus: doc_id to text."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}
