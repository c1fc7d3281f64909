"""Category totals, year-by-month tables and yearly comparisons."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import split_year
from tallybook.functions.money import exact_mean, magnitude
from tallybook.operators.months import MONTH_KEY, twelve_months, with_month
from tallybook.schema import MEAN_OF_YEARS, MONTH_CODES, MONTHLY_AVERAGE

_PIVOTED = [f"m{code}" for code in MONTH_CODES]


def category_share(selection: DataFrame) -> DataFrame:
    """Size of each category: the absolute value of its sum, so refunds net off."""
    return selection.groupBy("MainCategory").agg(
        F.abs(F.coalesce(F.sum("Amount"), F.lit(0))).alias("CategorySum")
    )


def category_bars(selection: DataFrame) -> DataFrame:
    """Category sizes, smallest first; equal sizes by name."""
    return (
        category_share(selection)
        .withColumnRenamed("MainCategory", "CategoryName")
        .orderBy("CategorySum", "CategoryName")
    )


def category_month_sums(selection: DataFrame) -> DataFrame:
    """Sum per category and month."""
    return _month_sums(selection, "MainCategory")


def year_month_pivot(selection: DataFrame) -> DataFrame:
    """One row per year, one column per month: ``m01`` to ``m12``."""
    return (
        with_month(_with_year(selection))
        .withColumn("_column", F.concat(F.lit("m"), MONTH_KEY))
        .groupBy("Year")
        .pivot("_column", _PIVOTED)
        .agg(F.sum("Amount"))
        .na.fill(0, _PIVOTED)
    )


def monthly_mean(selection: DataFrame) -> DataFrame:
    """Mean over the years per month; a year without postings in a month counts as zero."""
    means = [F.expr(f"CAST(sum({m}) AS DOUBLE) / count({m}) AS {m}") for m in _PIVOTED]
    # Grouping by a constant instead of by nothing gives no row for no years.
    return (
        year_month_pivot(selection)
        .groupBy(F.lit(True).alias("_whole"))
        .agg(*means)
        .drop("_whole")
    )


def seasonality(selection: DataFrame) -> DataFrame:
    """A twelve-month series per year, and the mean of the years.

    Each cell counts for its year, where it is alone, and for the mean.
    """
    years = _month_sums(_with_year(selection), "Year")
    series = f"""inline(array(
        struct(0 AS _kind, Year AS Series), struct(1 AS _kind, '{MONTHLY_AVERAGE}' AS Series)))"""
    return (
        years.selectExpr("Month", "Amount", series)
        .groupBy("_kind", "Series", "Month")
        .agg(F.expr("CAST(sum(Amount) AS DOUBLE) / count(Amount) AS Value"))
        .drop("_kind")
    )


def year_totals(selection: DataFrame) -> DataFrame:
    """Sum per year; a year with blank amounts only has the sum zero."""
    return selection.groupBy(split_year(F.col("Date")).alias("Year")).agg(
        F.coalesce(F.sum("Amount"), F.lit(0)).alias("Total")
    )


def year_comparison(selection: DataFrame) -> DataFrame:
    """Size of every year and of the mean year, the mean taken before rounding.

    The rollup gives both in one pass: the mean over one year is that year's sum.
    """
    mean = exact_mean(F.sum("Total"), F.count("Total"))
    label = F.when(F.col("_all") == 1, F.lit(MEAN_OF_YEARS)).otherwise(F.col("Year"))
    return (
        year_totals(selection)
        .rollup("Year")
        .agg(F.grouping("Year").alias("_all"), magnitude(mean).alias("Total"))
        .select(label.alias("Label"), "Total")
    )


def _month_sums(selection: DataFrame, key: str) -> DataFrame:
    return twelve_months(with_month(selection), [key], {"Amount": F.sum("Amount")})


def _with_year(selection: DataFrame) -> DataFrame:
    """Replace the literal ``Year`` text by the part of the date after the second slash."""
    return selection.withColumn("Year", split_year(F.col("Date")))
