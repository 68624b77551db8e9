import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from layerframe.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cpus=8, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
