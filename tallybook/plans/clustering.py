"""The stored ledger written anew so that categories skip files as accounts do."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallybook.functions.curves import range_number, z_order
from tallybook.schema import MONEY, POSITION
from tallybook.sources.tables import read_table, write_table

# Each axis of the curve has two to the power of this many ranges at most.
BITS = 6
_CELL = "_cell"


def cluster_by_category(
    spark: SparkSession,
    table: str,
    path: str,
    partitions: int | None = None,
    mode: str = "errorifexists",
    money: DecimalType = MONEY,
) -> DataFrame:
    """Write the ledger table along a curve over accounts and categories, and return the new one.

    Accounts and categories are each cut into ranges of about as many values. Rows go to files by
    year and by the cell their two ranges make, in Z-order: a file holds few ranges of both, so one
    account reads about the square root of a year's files, and so does one category, where the table
    of an ingest keeps accounts apart and has all categories in every file. The position splits a
    cell that has much of the data. Rows and answers are those of the given table.

    ``path`` must be another folder than ``table``. Blank values are values like others; an empty
    table gives an empty one. Batches that are appended to the new table later are clustered by
    account until it is written anew.
    """
    ledger = read_table(spark, table, money)
    accounts, categories = (
        range_number(F.col(c), range_starts(ledger, c)) for c in ("Account", "MainCategory")
    )
    celled = ledger.withColumn(_CELL, z_order(accounts, categories, BITS))
    keys = ("Year", _CELL, "Account", "MainCategory", "Month", POSITION)
    write_table(celled, path, mode, partitions, keys)
    return read_table(spark, path, money)


def range_starts(ledger: DataFrame, column: str, ranges: int = 1 << BITS) -> list[str]:
    """The least value of each range, ascending, when a column's values are cut into ranges.

    Spark's range exchange of the different values cuts them; only the starts reach the driver.
    """
    values = ledger.select(F.coalesce(column, F.lit("")).alias("value")).distinct()
    starts = (
        values.repartitionByRange(ranges, "value")
        .groupBy(F.spark_partition_id().alias("range"))
        .agg(F.min("value").alias("start"))
    )
    return [row["start"] for row in starts.orderBy("range").collect()]
