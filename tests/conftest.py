import os
import tempfile

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g pyspark-shell")

import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(os.environ.get("TIDEMARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="tidemark-tests-"))
    yield session
    session.stop()
