import os
import sys
from datetime import datetime

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from runloom.session import local_session

    session = local_session(8, 8, "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def smallest():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)
