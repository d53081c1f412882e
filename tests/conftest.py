import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tillcast.session import local_session
    s = local_session("*", 8, app="tillcast-tests")
    yield s
    s.stop()


@pytest.fixture
def scratch(tmp_path):
    """A fresh folder per test (tests run on one machine; the library itself
    writes under spark.checkpoint.dir)."""
    return str(tmp_path)
