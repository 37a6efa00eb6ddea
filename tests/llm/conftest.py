import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text[, source]) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        data = [(i, t, "en", s, len(t or ""), "x", 1, "y", 2.0) for i, t, s in rows]
        return spark.createDataFrame(
            data, "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, shard string, size double"
        )

    return make


@pytest.fixture(scope="session")
def real(spark):
    """The smallest driver table, as rows and as a frame."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], df
