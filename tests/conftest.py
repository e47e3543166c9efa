import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    folder = "/root/testdata/sf0.001"
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame from columns: frame(a=[1, 2], b=["x", None])."""

    def build(_schema=None, **columns):
        names = list(columns)
        rows = list(zip(*columns.values()))
        return spark.createDataFrame(rows, _schema or names)

    return build
