import pytest

from rankwell.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
