"""Small tables with every awkward case, and brute-force models of the contracts."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id string, row int, size string, h int, label int"


def awkward(spark, texts, langs=None, sources=None, ids=None):
    """documents with further columns whose names the operators use themselves."""
    n = len(texts)
    ids = ids if ids is not None else list(range(n))
    rows = [
        (ids[i], t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(t or ""), "x", "y", 7, "z", 1, 2)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def make(spark):
    return lambda *a, **k: awkward(spark, *a, **k)
