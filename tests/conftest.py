import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tessera.session import make_session, share_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = share_package(make_session("local[4]", 4, "4g"))
    yield session
    session.stop()
