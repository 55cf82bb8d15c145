"""One small session for all tests, with its own checkpoint folder."""

import pytest

from paperloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints").as_uri()
    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="3", spark__checkpoint__dir=folder, spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(folder)
    yield session
    session.stop()
