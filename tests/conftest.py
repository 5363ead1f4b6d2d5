import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shardflow.session import local_session

    scratch = tmp_path_factory.mktemp("scratch")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": str(scratch), "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture()
def partitions(spark):
    """Set the number of shuffle partitions inside a test."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)
