import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from redactflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    checkpoint = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": checkpoint, "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
