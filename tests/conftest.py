import pytest

from weftgraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, shuffle=4, **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
