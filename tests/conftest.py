import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from pastward.session import local_session

    return local_session(4, "tests")


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a schema text and tuples."""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make
