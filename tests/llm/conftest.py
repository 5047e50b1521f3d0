import pytest

from tidegauge.llm import queries


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark, sf):
    return lambda name: queries.table(spark, sf, name)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, key string, n int, a int, b int, total int").repartition(3)

    return make
