"""One local session for all tests."""

import pytest

from loomwork.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("loomwork-tests", cpus="4", partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
