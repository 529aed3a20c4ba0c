import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clipflow.session import HOT_ROWS, build_session

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", shuffle_partitions=4, spark__checkpoint__dir=str(shared))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def setting(spark):
    """Set a session value for one test."""
    changed = []

    def change(entry, value):
        changed.append(entry[0])
        spark.conf.set(entry[0], str(value))

    yield change
    for name in changed:
        spark.conf.unset(name)


@pytest.fixture
def all_hot(setting):
    """Every key with more than three rows counts as hot."""
    setting(HOT_ROWS, 3)
