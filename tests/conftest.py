import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session

    return local_session(4, memory="6g", partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")
