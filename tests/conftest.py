import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

DATA = os.environ.get("LODESTAR_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "4")), "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
