"""Reading CSV exports into the ledger."""

import csv
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from tallybook.functions import dates
from tallybook.functions.money import is_money, parse_money
from tallybook.functions.positions import after, batches_of, file_starts, in_batches, position
from tallybook.schema import (
    LEDGER_COLUMNS,
    MONEY,
    MONEY_COLUMNS,
    POSITION,
    RAW_SCHEMA,
    TEXT_COLUMNS,
    table_schema,
)
from tallybook.sources.files import Listing, first_line, name_in_uri, plain_files

# Names of files of about 100 bytes each; with more of them Spark decides how to join.
BROADCAST_FILES = 50_000
# What a compressed file may take up; its lines may be more than its bytes.
_COMPRESSED_WIDTH = 1 << 38
_HEADERS_AT_ONCE = 16
_BAD = "_bad"


def read_exports(
    spark: SparkSession,
    folder: str | Listing,
    multi_line: bool = False,
    batch: int = 0,
) -> DataFrame:
    """All plain files of one folder as text rows, the eight columns bound by position.

    Files of sub-folders are left out, whatever the sub-folder is called, and not listed either.
    A file whose name Spark would pass over is an error; only Spark's own markers may lie there.
    A line that does not have eight fields fails the job; ``bad_lines`` finds them all. Set
    ``multi_line`` for exports with line breaks inside quotes; such files are not split. ``batch``
    is the number of the ingest. A listing stands for the files it names.
    """
    listing = plain_files(spark, folder) if isinstance(folder, str) else folder
    if not listing.files:
        empty = StructType([*RAW_SCHEMA.fields, StructField(POSITION, LongType())])
        return spark.createDataFrame([], empty).na.fill("")
    reader = _exports_reader(spark, multi_line).schema(RAW_SCHEMA).option("mode", "FAILFAST")
    return _positioned(_placed(reader.csv(listing.sources())), listing, batch)


def bad_lines(
    spark: SparkSession,
    folder: str | Listing,
    multi_line: bool = False,
    normalize_dates: bool = False,
    money: DecimalType = MONEY,
    batch: int = 0,
) -> DataFrame:
    """Every line that an ingest would fail on: ``File, Reason, Text`` and the position.

    The reason is ``fields`` for another number of fields than eight, with the whole line, or the
    column whose text is no amount or date, with that text. A line may have several reasons.
    """
    listing = plain_files(spark, folder) if isinstance(folder, str) else folder
    empty = f"File string, Reason string, Text string, {POSITION} bigint"
    if not listing.files:
        return spark.createDataFrame([], empty)
    with_bad = StructType([*RAW_SCHEMA.fields, StructField(_BAD, StringType())])
    reader = _exports_reader(spark, multi_line).schema(with_bad).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", _BAD).csv(listing.sources())
    whole = F.col(_BAD).isNull()

    def reason(name: str, bad: Column, text: str) -> Column:
        return F.when(bad, F.struct(F.lit(name).alias("Reason"), F.col(text).alias("Text")))

    reasons = [reason("fields", ~whole, _BAD)]
    reasons += [reason(c, whole & ~is_money(F.col(c), money), c) for c in MONEY_COLUMNS]
    if normalize_dates:
        reasons.append(reason("Date", whole & ~dates.is_plain_date(F.col("Date")), "Date"))
    placed = _placed(rows, F.array_compact(F.array(*reasons)).alias("_reasons"))
    found = _positioned(placed.where(F.size("_reasons") > 0), listing, batch, "_name", "_reasons")
    return found.select(F.col("_name").alias("File"), F.inline("_reasons"), POSITION)


def read_combined(
    spark: SparkSession, path: str, multi_line: bool = False, batch: int = 0
) -> DataFrame:
    """A combined CSV as text rows, columns chosen by header name, other columns ignored.

    The path is a file or a folder of files. Every file goes by its own header, upper and lower
    case alike; one that lacks a column, or has it twice, is an error that names the file. A file
    without a line has no rows.
    """
    listing = plain_files(spark, path)
    if not listing.files:
        raise ValueError(f"no file to read: {path}")
    # Headers are read here as Spark reads the first one, some files at a time.
    with ThreadPoolExecutor(_HEADERS_AT_ONCE) as pool:
        lines = pool.map(lambda file: first_line(spark, file.path), listing.files)
        headers = [None if line is None else tuple(next(csv.reader([line]))) for line in lines]
    groups: dict[tuple[str, ...], list[int]] = {}
    for number, header in enumerate(headers):
        if header is not None:
            groups.setdefault(header, []).append(number)
    parts = []
    for header, numbers in groups.items():
        columns = _columns_of(header, listing.files[numbers[0]].name)
        names = [f"_c{i}" for i in range(len(header))]
        one_header = listing.only(numbers)
        rows = (
            _exports_reader(spark, multi_line)
            .schema(StructType([StructField(name, StringType()) for name in names]))
            .csv(one_header.sources())
        )
        chosen = {c: F.col(names[at]) for c, at in columns.items()}
        parts.append(_placed(rows.withColumns(chosen)))
    if not parts:
        return read_exports(spark, listing.only([]), batch=batch)
    return _positioned(reduce(DataFrame.unionByName, parts), listing, batch)


def _columns_of(header: Iterable[str], file: str) -> dict[str, int]:
    """Where the eight columns stand in a header."""
    names = [name.lstrip("\ufeff").lower() for name in header]
    for column in LEDGER_COLUMNS:
        found = names.count(column.lower())
        if found != 1:
            raise ValueError(f"{found} columns {column} in the header of {file}")
    return {column: names.index(column.lower()) for column in LEDGER_COLUMNS}


def with_period(raw: DataFrame, normalize_dates: bool = False) -> DataFrame:
    """Add the texts ``Year`` and ``Month`` that selectors compare."""
    date = F.col("Date")
    if normalize_dates:
        raw = raw.withColumn("Date", dates.normalized_date(date))
    return raw.withColumns({"Year": dates.year_text(date), "Month": dates.month_text(date)})


def typed_ledger(
    raw: DataFrame, normalize_dates: bool = False, money: DecimalType = MONEY
) -> DataFrame:
    """Text rows to the typed ledger."""
    table_schema(money)  # raises for money that the reports could not average exactly
    return with_period(raw, normalize_dates).withColumns(
        {
            "LedgerDate": dates.ledger_date(F.col("Date")),
            **{c: parse_money(F.col(c), money) for c in MONEY_COLUMNS},
        }
    )


def union_all(*ledgers: DataFrame) -> DataFrame:
    """Bag union of ledgers by column name, the lines of each after those of the one before."""
    moved, before = [], 0
    for ledger in ledgers:
        if POSITION in ledger.columns:
            batches = batches_of(ledger)
            place = after(F.col(POSITION), before)
            ledger = ledger.withColumn(POSITION, in_batches(place, before + batches))
            before += batches
        moved.append(ledger)
    union = reduce(DataFrame.unionByName, moved)
    if POSITION not in union.columns:
        return union
    return union.withColumn(POSITION, in_batches(F.col(POSITION), before))


def _exports_reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        # A pruned read would not notice a line with missing fields.
        .option("columnPruning", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        # Keeps folders called a=b from becoming columns.
        .option("recursiveFileLookup", True)
    )


def _placed(rows: DataFrame, *more: Column) -> DataFrame:
    """The text rows, the name of their file and their place in it.

    The place is the start of the block that a task reads, plus the number of the row within the
    task. No block has more lines than bytes, and a block that is not the first of its task is the
    last of its file, so places grow along the file and stay apart.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(
        *LEDGER_COLUMNS,
        F.col("_metadata.file_name").alias("_name"),
        (F.col("_metadata.file_block_start") + in_task).alias("_line"),
        *more,
    ).na.fill("", list(TEXT_COLUMNS))


def _positioned(placed: DataFrame, listing: Listing, batch: int, *more: str) -> DataFrame:
    """Put the position in place of file and line: batch, start of the file's range, place there."""
    spark = placed.sparkSession
    widths = _widths(spark, listing)
    ranges = [
        (name_in_uri(spark, file), start, width)
        for file, start, width in zip(listing.files, file_starts(widths), widths)
    ]
    names = spark.createDataFrame(ranges, "_name string, _start bigint, _width bigint")
    if len(ranges) <= BROADCAST_FILES:
        names = F.broadcast(names)
    place = position(batch, F.col("_start"), F.col("_width"), F.col("_line"))
    # A file that is not among the names has no position and raises.
    return placed.join(names, "_name", "left").select(
        *LEDGER_COLUMNS, in_batches(place, batch + 1), *more
    )


def _widths(spark: SparkSession, listing: Listing) -> list[int]:
    """How many places each file needs: a line for each byte, behind what its task read before."""
    if any(file.compressed for file in listing.files):
        return [_COMPRESSED_WIDTH] * len(listing.files)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    in_a_task = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
    before = min(sum(file.length for file in listing.files), in_a_task)
    return [file.length + before + 1 for file in listing.files]
