import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tributary.session import build_session, ship

    s = build_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    ship(s)
    return s
