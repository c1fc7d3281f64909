"""Choosing transactions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import current_year
from tallybook.schema import ALL, ALL_MONTHS, DEFAULT_SEARCH_CATEGORY


def select_transactions(
    ledger: DataFrame,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
    flow: str | None = None,
) -> DataFrame:
    """Transactions of a year, narrowed by month, money flow, account and category.

    The category only counts together with an account. The year defaults to the current one.
    """
    wanted = F.col("Year") == (current_year() if year is None else F.lit(year))
    if month != ALL_MONTHS:
        wanted &= F.col("Month") == month
    if flow is not None:
        wanted &= F.col("Subcategory") == flow
    if account != ALL:
        wanted &= F.col("Account") == account
        if category != ALL:
            wanted &= F.col("MainCategory") == category
    return ledger.where(wanted)


def select_category(ledger: DataFrame, category: str = DEFAULT_SEARCH_CATEGORY) -> DataFrame:
    """All years of one category."""
    return ledger.where(F.col("MainCategory") == category)
