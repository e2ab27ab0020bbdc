import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tidegrid import build_session

    session = build_session("local[4]", 4, "tidegrid-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
