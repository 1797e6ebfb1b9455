import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from tideline.session import local_session

    session = local_session(4, "4g", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    root = DATA / "sf0.001"
    if not root.exists():
        pytest.skip("no test tables here")
    return str(root)
