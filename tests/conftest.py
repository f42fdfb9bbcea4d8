import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from actiscope.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__debug__maxToStringFields="50"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture
def states(spark):
    """Layer states from (instruction, layer, input, output) rows."""
    from actiscope.schema import LAYER_STATE_SCHEMA

    return lambda rows: spark.createDataFrame(rows, LAYER_STATE_SCHEMA)
