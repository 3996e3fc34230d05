import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from claimloom import session

    built = session.build("local[4]", 4)
    built.sparkContext.setLogLevel("ERROR")
    return built
