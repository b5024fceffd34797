import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def rows():
    """Rows of a table of the small scale, as tuples, read without Spark."""
    def read(name, columns="*"):
        return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()
    return read


@pytest.fixture
def put(spark, tmp_path):
    """Write rows as a table of a folder that a query can be given."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def put_docs(put):
    def write(texts):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
        return put("documents", rows, DOCS)
    return write
