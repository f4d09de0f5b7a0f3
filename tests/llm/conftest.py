import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def frame(spark):
    """A documents table, with an extra column, from (doc_id, text) rows."""

    def make(rows, extra="source"):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id long, text string, {extra} string")

    return make
