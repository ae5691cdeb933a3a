import tempfile

import pytest

from titlesieve.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="titlesieve-tests-"),
    })
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
