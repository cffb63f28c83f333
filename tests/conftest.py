import pytest

from tallyweave.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session(master="local[2]", partitions=2)
    s.sparkContext.setLogLevel("ERROR")
    return s
