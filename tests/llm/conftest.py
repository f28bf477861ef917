import pytest

from prosopo.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def table(spark):
    """Rows as a DataFrame over several partitions."""
    def make(rows, schema, parts=3):
        df = spark.createDataFrame(rows, schema)
        return df.repartition(parts) if rows else df
    return make
