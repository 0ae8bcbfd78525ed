import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a schema string to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
