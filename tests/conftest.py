import pytest

from specloom.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
