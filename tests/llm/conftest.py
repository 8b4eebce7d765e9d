import pytest

from cardtrail.session import build_session


@pytest.fixture(scope="session")
def spark():
    # the session of the other tests if they run too
    yield build_session("local[4]", app="cardtrail-llm-tests", shuffle_partitions=4)
