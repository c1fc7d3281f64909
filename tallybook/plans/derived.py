"""Small tables beside the stored ledger, kept up to date batch by batch.

Both are made from the batches of the ledger table that they have not seen. A refresh that ended
halfway is done again by the next one, without counting anything twice.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from tallybook.functions.positions import batch_of, batches_of, first_of_batch, of_batch
from tallybook.operators.condense import GROUP, LAST, condensed_state, merge_states
from tallybook.plans.ingest import exists
from tallybook.schema import MONEY, table_schema
from tallybook.sources.tables import read_table

# What the selectors offer, and the batch that brought it.
_LISTED = ("Year", "Month", "Account", "MainCategory")
_DICTIONARY = "Month string, Account string, MainCategory string, _batch bigint, Year string"


def refresh_condensed(
    spark: SparkSession, table: str, path: str, money: DecimalType = MONEY
) -> DataFrame:
    """Merge new batches of the ledger table into its condensed ledger, and return that.

    Only years that a batch has lines of are read and written again. Years without a text are a
    year of their own. One refresh of a table runs at a time.
    """
    ledger = read_table(spark, table, money)
    for batch in range(_last_batch(_state(spark, path, money), LAST), batches_of(ledger)):
        first, state = first_of_batch(batch), _state(spark, path, money)
        new = condensed_state(ledger.where(of_batch(batch)))
        if state is not None:
            seen = state.where(F.col(LAST) >= first).select(*GROUP)
            new = new.join(seen, list(GROUP), "left_anti")
        years = [row["Year"] for row in new.select("Year").distinct().collect()]
        if not years:
            continue
        if state is not None:
            new = merge_states(state.where(F.col("Year").isin(years)), new, first)
        (
            new.repartitionByRange("Year", "Account", "Month")
            .write.mode("overwrite")
            # Replaces the years that are written, and no others.
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("Year")
            .parquet(path)
        )
    return read_condensed(spark, path, money)


def read_condensed(spark: SparkSession, path: str, money: DecimalType = MONEY) -> DataFrame:
    """The condensed ledger that ``refresh_condensed`` keeps; all reports run on it."""
    return read_table(spark, path, _wide(money))


def refresh_dictionary(
    spark: SparkSession, table: str, path: str, money: DecimalType = MONEY
) -> DataFrame:
    """Add what new batches of the ledger table bring to the lists, and return the dictionary.

    It has the years, months, accounts and categories that occur together, so the lists of
    ``operators.dimensions`` are the same on it as on the ledger. Batches behind the last one that
    brought something are looked at again.
    """
    ledger = read_table(spark, table, money)
    known = read_dictionary(spark, path) if exists(spark, path) else None
    for batch in range(_last_batch(known, "_batch", False), batches_of(ledger)):
        new = ledger.where(of_batch(batch)).select(*_LISTED).distinct()
        if known is not None:
            new = new.join(known.select(*_LISTED), list(_LISTED), "left_anti")
        (
            new.withColumn("_batch", F.lit(batch).cast("bigint"))
            .coalesce(1)  # a few short rows for each account
            .write.mode("append")
            .partitionBy("Year")
            .parquet(path)
        )
        known = read_dictionary(spark, path)
    return read_dictionary(spark, path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_DICTIONARY).parquet(path)
    return rows.withColumn("Year", F.coalesce("Year", F.lit("")))


def table_years(spark: SparkSession, path: str) -> DataFrame:
    """The years of a stored table, from the names of its directories alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    years = []
    entries = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    for entry in entries:
        name, _, text = entry.getPath().getName().partition("=")
        if entry.isDirectory() and name == "Year":
            year = utils.unescapePathName(text)
            years.append(("" if year == utils.DEFAULT_PARTITION_NAME() else year,))
    return spark.createDataFrame(years, "value string").orderBy("value")


def _state(spark: SparkSession, path: str, money: DecimalType) -> DataFrame | None:
    if not exists(spark, path):
        return None
    schema = table_schema(_wide(money))
    with_last = StructType([*schema.fields[:-1], StructField(LAST, LongType()), schema["Year"]])
    rows = spark.read.schema(with_last).parquet(path)
    return rows.withColumn("Year", F.coalesce("Year", F.lit(""))).select(*schema.names, LAST)


def _last_batch(rows: DataFrame | None, column: str, position: bool = True) -> int:
    """The batch that the rows have seen last, which may have been cut off; 0 without rows."""
    last = None if rows is None else rows.agg(F.max(column)).first()[0]
    if last is None:
        return 0
    return batch_of(last) if position else last


def _wide(money: DecimalType) -> DecimalType:
    """The type of a condensed amount."""
    return DecimalType(min(money.precision + 10, 38), money.scale)
