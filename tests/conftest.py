import pytest

from loomgraph.session import session


@pytest.fixture(scope="session")
def spark():
    return session(4, partitions=4)
