import pytest

from cardloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    yield session
    session.stop()
