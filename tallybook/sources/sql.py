"""The ledger as a SQL table."""

from pyspark.sql import DataFrame, SparkSession

LEDGER_VIEW = "ledger"


def register(ledger: DataFrame, name: str = LEDGER_VIEW) -> DataFrame:
    ledger.createOrReplaceTempView(name)
    return ledger


def fetch(spark: SparkSession, query: str, **parameters) -> DataFrame:
    """Run a query text; values go in as named parameters (``:name``), never spliced in."""
    return spark.sql(query, args=parameters)
