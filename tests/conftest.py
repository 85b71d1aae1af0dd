import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citegrain.catalog.registry import SESSION_SETTINGS  # noqa: E402
from tests.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    for name, value in SESSION_SETTINGS.items():
        session.conf.set(name, value)
    yield session
    session.stop()
