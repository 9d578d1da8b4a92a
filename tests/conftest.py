import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from lodestrata.session import local_session

    return local_session(8, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
