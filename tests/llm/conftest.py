import pytest

#: Columns whose names the operators use inside.
CLASHING = "key string, deal string, shard string, ids string, term string, label string, score string, n string, vec string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, shared ids, and columns with clashing names."""
    long_text = "word other thing. " * 20_000
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of the same id"), (2, None), (3, ""), (None, "no id here"), (None, None), (5, long_text), (6, "a\tb\n\n c  d e <|endoftext|> İ"), (7, "...")]
    names = [c.split()[0] for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *names) for r in rows], f"doc_id long, text string, {CLASHING}")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
