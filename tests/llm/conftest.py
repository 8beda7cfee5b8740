import pytest

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words long, hi long, spans string, items string, chunk long, node string"


def odd_documents(spark, texts):
    """Documents with columns whose names the operators use too; ids from 0, then whatever a case adds."""
    rows = [(i, t, "en", 1, 2, "x", "y", 3, "z") if not isinstance(t, tuple) else (*t, "en", 1, 2, "x", "y", 3, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def given(spark):
    """(id, text) of the smallest test table."""
    return [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()]
