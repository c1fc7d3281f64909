"""Writing ledgers and reading the stored table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallybook.schema import LEDGER_COLUMNS, MONEY, POSITION, table_schema


_CLUSTERED = ("Year", "Account", "Month", POSITION)


def write_combined(ledger: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the eight columns as CSV with a header, rows in ingest order.

    The order matters: a reader takes a month's closing balance from its last line.
    """
    (
        ledger.orderBy(POSITION)
        .select(*LEDGER_COLUMNS)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_table(
    ledger: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partitions: int | None = None,
    clustered: Sequence[str | Column] = _CLUSTERED,
) -> None:
    """Store the typed ledger as parquet, one directory per ``Year``.

    Rows are dealt to ``partitions`` tasks (the session's number if not given) by ranges of year,
    account, month and position, and sorted by them. A file holds a short range of accounts and
    months, which lets a reader skip files and row groups by their least and greatest values. The
    position splits an account that has much of the data, without any help at run time.
    ``clustered`` gives other keys; they begin with the year and should end with the position.
    """
    number = [] if partitions is None else [partitions]
    (
        ledger.repartitionByRange(*number, *clustered)
        .sortWithinPartitions(*clustered)
        .select(table_schema().names)
        .write.mode(mode)
        # An overwrite replaces the whole table, also the years that no longer occur.
        .option("partitionOverwriteMode", "static")
        .partitionBy("Year")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, money: DecimalType = MONEY) -> DataFrame:
    """The stored ledger; a filter on ``Year`` prunes directories."""
    rows = spark.read.schema(table_schema(money)).parquet(path)
    # A blank partition value is stored as NULL.
    return rows.withColumn("Year", F.coalesce("Year", F.lit("")))


def write_records(view: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a view as JSON lines, missing cells as null."""
    view.write.mode(mode).option("ignoreNullFields", False).json(path)
