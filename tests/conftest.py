import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session, ready

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield ready(session)
    session.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Orders of a few rows take the path of many chunks."""
    from millrace import positions

    monkeypatch.setattr(positions, "CHUNK_ROWS", 6)
