import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridlore.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", 4)
