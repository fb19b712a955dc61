import pytest

from procspark.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", shuffle_partitions=4)
    yield session
    session.stop()
