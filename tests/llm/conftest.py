from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (id, text) or (id, text, lang, source) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties."""
    return [(1, None, None, None), (2, "", "en", None), (3, "word " * 30_000, "en", "a"), (4, "same text here", "en", "a"), (4, "same text here", "en", "a"), (5, "same text here", "de", "b"), (None, "no id", "en", "a"), (6, "\n\n \t\n", "en", "a"), (7, "12345 !!", "en", "a")]
