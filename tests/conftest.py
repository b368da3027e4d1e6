import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from voxtally import session

    return session.build("local[8]", 8, "6g")


@pytest.fixture(scope="session")
def base():
    return "/root/testdata/sf0.001"
