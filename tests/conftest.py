import pytest

from recfuse import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8, {"spark.driver.memory": "4g", "spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
