import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from driver_tables import TESTDATA  # noqa: E402

TABLES = ("orders", "customer")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallybook-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    def connect(sf):
        connection = duckdb.connect()
        for table in TABLES:
            connection.execute(
                f"CREATE VIEW {table} AS FROM '{TESTDATA}/sf{sf}/{table}.parquet'"
            )
        return connection

    return connect
