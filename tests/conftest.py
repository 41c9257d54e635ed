import pytest

from marketlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4", spark__driver__memory="4g", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()
