"""Folder of exports to stored ledger."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType

from tallybook.functions.positions import batches_of
from tallybook.schema import MONEY, POSITION
from tallybook.sources.exports import bad_lines, read_exports, typed_ledger
from tallybook.sources.files import Listing, plain_files
from tallybook.sources.tables import read_table, write_table

SHOWN_LINES = 20


class BadLines(PySparkException):
    """Lines that kept an ingest from being done: how many, and the first of them in order."""

    def __init__(self, count: int, lines: list[tuple[str, str, str]]) -> None:
        self.count, self.lines = count, lines
        shown = "".join(f"\n{file}: {reason}: {text}" for file, reason, text in lines)
        super().__init__(message=f"{count} bad lines or cells, first of all{shown}")


def ingest(
    spark: SparkSession,
    folder: str,
    table: str,
    mode: str = "errorifexists",
    multi_line: bool = False,
    normalize_dates: bool = False,
    money: DecimalType = MONEY,
) -> DataFrame:
    """Combine all exports of a folder into the ledger table and return that table.

    Appended lines come after those the table has. One ingest into a table runs at a time. Where
    lines cannot be read, nothing is written, and ``BadLines`` tells of all of them; they are only
    looked for once a write has failed.
    """
    batch = 0
    if mode == "append" and exists(spark, table):
        batch = batches_of(read_table(spark, table, money))
    listing = plain_files(spark, folder)
    raw = read_exports(spark, listing, multi_line, batch)
    ledger = typed_ledger(raw, normalize_dates, money)
    ingest_files(spark, ledger, listing, table, mode, multi_line, normalize_dates, money, batch)
    return read_table(spark, table, money)


def ingest_files(
    spark: SparkSession,
    ledger: DataFrame,
    files: Listing,
    table: str,
    mode: str,
    multi_line: bool,
    normalize_dates: bool,
    money: DecimalType,
    batch: int,
) -> None:
    """Write the ledger that was made of the files, or tell of their bad lines."""
    try:
        write_table(ledger, table, mode)
    except AnalysisException:
        raise
    except (PySparkException, Py4JJavaError) as failure:
        found = bad_lines(spark, files, multi_line, normalize_dates, money, batch)
        count = found.count()
        if not count:
            raise
        first = found.orderBy(POSITION, "Reason").limit(SHOWN_LINES).collect()
        lines = [(line["File"], line["Reason"], line["Text"]) for line in first]
        raise BadLines(count, lines) from failure


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
