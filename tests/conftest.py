import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wearcast.session import get_session
    s = get_session("local[4]", app_name="wearcast-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from tests.oracle import duck
    return duck(SF_MID)
