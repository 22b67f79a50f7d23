import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import get_session

    return get_session("tests", cpus=8, shuffle_partitions=8)
