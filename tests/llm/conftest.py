import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text), with columns whose names clash with the operators' own."""
    def make(rows):
        schema = "doc_id long, text string, score double, n long, h string, spans string, text_key string, length int"
        return spark.createDataFrame([(i, t, 0.5, 1, "x", "y", "z", 3) for i, t in rows], schema)
    return make
