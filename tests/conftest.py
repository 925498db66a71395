import pytest

from marlstone.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cpus=8, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
