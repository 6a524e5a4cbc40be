import pytest

from metrum.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", "tests", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
