"""The reports. Money leaves here as double."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import money_as_double
from tallybook.operators import balances, combined, totals
from tallybook.operators.balances import Order
from tallybook.operators.selection import select_category, select_transactions
from tallybook.schema import ALL, ALL_MONTHS, DEFAULT_SEARCH_CATEGORY, END_OF_MONTH


def history(
    ledger: DataFrame,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
    order: Order = "ingest",
) -> DataFrame:
    """Monthly series (Series, Month, Value): of every account and their totals, or of one account."""
    selection = select_transactions(ledger, account, category, year, month)
    if account == ALL:
        return money_as_double(balances.account_history(selection, category, order))
    return _end_of_month(selection, order)


def flow_share(
    ledger: DataFrame,
    flow: str,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
) -> DataFrame:
    """Size of each category among the expenses or the income (MainCategory, CategorySum)."""
    selection = select_transactions(ledger, account, category, year, month, flow)
    return money_as_double(totals.category_share(selection))


def flow_breakdown(
    ledger: DataFrame,
    flow: str,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
    order: Order = "ingest",
) -> DataFrame:
    """Expenses or income in more detail.

    One month: category sizes, smallest first (CategoryName, CategorySum). A whole year:
    monthly series (Series, Month, Value), of every category or of one account's balance.
    """
    selection = select_transactions(ledger, account, category, year, month, flow)
    if month != ALL_MONTHS:
        return money_as_double(totals.category_bars(selection))
    if account == ALL:
        return money_as_double(totals.category_month_sums(selection)).select(
            F.col("MainCategory").alias("Series"), "Month", F.col("Amount").alias("Value")
        )
    return _end_of_month(selection, order)


def selection_reports(
    ledger: DataFrame,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
) -> DataFrame:
    """All reports that one change of a selector asks for (Report, Series, Month, Value).

    The rows are those of ``history``, and of ``flow_share`` and ``flow_breakdown`` of both flows;
    sizes of categories stand under the chosen month, ``00`` for the whole year. Which line of a
    month is the last goes by the order of the export.
    """
    selection = select_transactions(ledger, account, category, year, month)
    return combined.selection_reports(selection, account, category, month)


def category_seasonality(
    ledger: DataFrame, category: str = DEFAULT_SEARCH_CATEGORY
) -> DataFrame:
    """Monthly series of every year of a category and their mean (Series, Month, Value)."""
    return totals.seasonality(select_category(ledger, category))


def category_years(ledger: DataFrame, category: str = DEFAULT_SEARCH_CATEGORY) -> DataFrame:
    """Size of every year of a category and of the mean year (Label, Total)."""
    return money_as_double(totals.year_comparison(select_category(ledger, category)))


def _end_of_month(selection: DataFrame, order: Order) -> DataFrame:
    return money_as_double(balances.month_end_balance(selection, order)).select(
        F.lit(END_OF_MONTH).alias("Series"), "Month", F.col("EndBalance").alias("Value")
    )
