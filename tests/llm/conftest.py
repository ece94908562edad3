import pytest

from tests.llm.tables import awkward_rows, documents


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return documents(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, []).repartition(2)
