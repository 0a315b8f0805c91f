import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gleanery.session import build_session, ship_with_tasks  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = build_session(
        "gleanery-tests", "local[4]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    session.sparkContext.setLogLevel("OFF")
    ship_with_tasks()
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """``values(column, rows...)``: evaluate a column over one string column ``x``."""

    def run(column, items):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
        return [r[1] for r in sorted(rows.select("i", column.alias("y")).collect())]

    return run
