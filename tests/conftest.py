import pytest

from tressage.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, shuffle_partitions=4, memory="6g")


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA
