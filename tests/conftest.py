import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from augeval.session import get_spark
    s = get_spark("local[4]", app="augeval-tests", shuffle_partitions=8)
    yield s
    from augeval.session import drop_scratch
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SMOKE
