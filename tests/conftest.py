import os

import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
