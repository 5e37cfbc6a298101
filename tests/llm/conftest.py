import pytest


def make(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, kept string, score double, spans int"):
    """A documents table with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", 0.0, 1) for i, t in rows], schema)


@pytest.fixture
def docs(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
