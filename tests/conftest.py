import pytest

from tapeloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="8g")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Small frame from a DDL schema and rows."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build
