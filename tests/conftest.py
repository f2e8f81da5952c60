import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lifecurve.operators.ordered import CHUNK_ROWS_SETTING  # noqa: E402
from lifecurve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", memory="4g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "chunked"])
def layout(spark, request):
    """Run a test with whole keys, and with keys split into chunks of 25 rows."""
    if request.param == "chunked":
        spark.conf.set(CHUNK_ROWS_SETTING, "25")
    yield request.param
    spark.conf.unset(CHUNK_ROWS_SETTING)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
