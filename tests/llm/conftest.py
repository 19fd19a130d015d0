from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text[, lang[, source]]) rows."""

    def build(*rows):
        full = [(*r, *("en", "s")[len(r) - 2 :], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def sample():
    """doc_id, text, lang, source of the smallest documents table."""
    import duckdb

    return duckdb.sql("select doc_id, text, lang, source from '/root/testdata/sf0.001/documents.parquet' order by 1").fetchall()
