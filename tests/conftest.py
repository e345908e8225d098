import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tapline.session import build

    s = build("tests", master="local[8]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
