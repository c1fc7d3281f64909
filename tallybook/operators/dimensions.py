"""Lists of the values a selector offers, each sorted by code point."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import month_label
from tallybook.schema import ALL, MONTH_LABELS


def accounts(ledger: DataFrame) -> DataFrame:
    return _with_all(ledger.select(F.col("Account").alias("value")))


def categories(ledger: DataFrame) -> DataFrame:
    return _with_all(ledger.select(F.col("MainCategory").alias("value")))


def account_categories(ledger: DataFrame, account: str = ALL) -> DataFrame:
    """Categories of one account; the sentinel account has none of its own."""
    return categories(ledger.where(F.col("Account") == account))


def years(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.col("Year").alias("value")).distinct().orderBy("value")


def month_options(ledger: DataFrame) -> DataFrame:
    """The thirteen month choices, label and code."""
    codes = F.explode(F.array(*[F.lit(c) for c in MONTH_LABELS]))
    options = _one_row(ledger).select(codes.alias("code"))
    return options.select(month_label(F.col("code")).alias("label"), "code")


def months_in_use(ledger: DataFrame) -> DataFrame:
    """The choices a ledger can answer: ``All`` and the months it has postings in.

    A month text that is no code, as an unpadded date has it, is its own label.
    """
    codes = append_row(ledger.select(F.col("Month").alias("code")).distinct(), code=F.lit("00"))
    label = F.coalesce(month_label(F.col("code")), F.col("code"))
    return codes.select(label.alias("label"), "code")


def append_row(frame: DataFrame, **values: Column) -> DataFrame:
    """Bag union with one more row."""
    row = _one_row(frame).select(*[v.alias(k) for k, v in values.items()])
    return frame.unionByName(row)


def _one_row(frame: DataFrame) -> DataFrame:
    # In one partition: the default is one per core of the cluster.
    return frame.sparkSession.range(0, 1, 1, 1)


def _with_all(values: DataFrame) -> DataFrame:
    return append_row(values.distinct(), value=F.lit(ALL)).orderBy("value")
