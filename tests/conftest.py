import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from habitlake.session import get_session
    return get_session("local[8]", "habitlake-tests", 8)


@pytest.fixture(scope="session")
def fx(spark):
    from habitlake.sources.fixtures import Fixtures
    return Fixtures(spark, SF_SMALL)
