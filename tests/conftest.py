import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomlog.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def to_lines(spark, values, session="s"):
    """Raw lines of one session from Python values; strings are taken as they are."""
    import json

    rows = [
        (session, i, v if isinstance(v, str) else json.dumps(v, separators=(",", ":")))
        for i, v in enumerate(values, 1)
    ]
    return spark.createDataFrame(rows, "session_id string, line bigint, raw string")
