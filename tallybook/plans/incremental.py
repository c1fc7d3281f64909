"""New exports of a folder, appended to the stored ledger as they come."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallybook.functions.positions import batches_of, of_batch
from tallybook.plans.ingest import exists, ingest_files
from tallybook.schema import MONEY, POSITION
from tallybook.sources.exports import read_exports, typed_ledger
from tallybook.sources.files import Listing, PlainFile, literal, plain_files
from tallybook.sources.tables import read_table

# Columns of Spark's source of whole files. The content is not asked for and hence not read.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_FIRST = "_first_batch"


def ingest_new(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    multi_line: bool = False,
    normalize_dates: bool = False,
    money: DecimalType = MONEY,
) -> DataFrame:
    """Append the exports that no earlier run with this checkpoint has seen; return the table.

    A stream of the folder's file names remembers in ``checkpoint`` what was read. Each of its
    batches is an ingest of the new files, in the order of their names and after all lines that the
    table has; so the order is that of one ingest if files arrive in the order of their names. A
    run that ends before its batch is noted is repeated by the next one, and lines that reached the
    table are not written again. While a folder is read so, nothing else may append to the table.
    """
    plain_files(spark, folder)  # a file that Spark would pass over is an error, as in one ingest
    first = _first_batch(spark, table, checkpoint, money)

    def append(new: DataFrame, number: int) -> None:
        # One short row for each new file; sub-folders are left out.
        found = sorted(
            (PlainFile(row["path"].rpartition("/")[2], row["path"], row["length"])
             for row in new.where(_directly_in(spark, folder)).collect()),
            key=lambda file: file.name,
        )
        if found:
            write_batch(spark, Listing(tuple(found)), table, first + number,
                        multi_line, normalize_dates, money)

    (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .load(literal(folder))
        .select("path", "length")
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return read_table(spark, table, money)


def write_batch(
    spark: SparkSession,
    files: Listing,
    table: str,
    batch: int,
    multi_line: bool = False,
    normalize_dates: bool = False,
    money: DecimalType = MONEY,
) -> None:
    """Append the files as that batch, but for the lines of it that the table has already."""
    ledger = typed_ledger(read_exports(spark, files, multi_line, batch), normalize_dates, money)
    if exists(spark, table):
        # The filter is a range of the position, which the footers of other batches rule out.
        written = read_table(spark, table, money).where(of_batch(batch)).select(POSITION)
        if not written.isEmpty():
            ledger = ledger.join(written, POSITION, "left_anti")
    ingest_files(spark, ledger, files, table, "append", multi_line, normalize_dates, money, batch)


def _first_batch(spark: SparkSession, table: str, checkpoint: str, money: DecimalType) -> int:
    """The number of the stream's first batch, noted beside the checkpoint when it is first asked."""
    place = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, _FIRST)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        return spark.read.schema("first bigint").json(place.toString()).first()["first"]
    first = batches_of(read_table(spark, table, money)) if exists(spark, table) else 0
    frame = spark.range(0, 1, 1, 1).select(F.lit(first).cast("bigint").alias("first"))
    frame.write.mode("overwrite").json(place.toString())
    return first


def _directly_in(spark: SparkSession, folder: str) -> Column:
    """Whether a path lies in the folder itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.makeQualified(place).toString().rstrip("/")
    return F.regexp_replace("path", "/[^/]*$", "") == whole
