import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from galley.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture(params=["3", "32768"])
def blocks(request, spark):
    """Run a test with tiny and with normal scan blocks: results must not differ."""
    spark.conf.set("galley.scan.blockRows", request.param)
    yield request.param
    spark.conf.unset("galley.scan.blockRows")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
