import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing():
    """Adds columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = ["row", "line", "a", "b", "key", "core", "kept", "n_words", "score", "removed", "_text", "_row", "tree", "block", "epoch", "tokens", "ids", "term", "id", "text_hash", "n_lines", "_words"]
    return lambda df: df.withColumns({n: F.lit("x") for n in names})
