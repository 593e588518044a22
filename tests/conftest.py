import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelspark.session import build_session, clear_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", "6g")
    yield session
    clear_staged(session)
    session.stop()
