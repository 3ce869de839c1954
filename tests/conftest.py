import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from archspan.runtime import session

    return session("tests", cpus="8", partitions="4", memory="6g")


@pytest.fixture
def scratch(spark):
    from archspan.runtime import Scratch

    return Scratch(spark, "test")
