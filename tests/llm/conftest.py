import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Write tables of a folder: tables(documents=[rows], ...) with a schema each, and give its path."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
