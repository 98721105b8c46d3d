import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from navlytics.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", os.environ.get("TEST_CPUS", "8"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
