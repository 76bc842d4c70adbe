import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents():
    """Rows of the small documents table, by id."""
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture
def docs(spark):
    """A documents frame from (doc_id, text) pairs, with an extra column whose name clashes with inner ones."""

    def build(rows, extra="id"):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id bigint, text string, {extra} string")

    return build
