import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark.session import local_session, name_shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4)
    name_shared_folder(session, str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
