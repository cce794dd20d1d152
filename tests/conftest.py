import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textreg.session import local_session

    session = local_session(8, shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return TESTDATA
