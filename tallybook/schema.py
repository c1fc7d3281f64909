"""The ledger data model: column names, types and the fixed values of the selectors."""

from pyspark.sql.types import (
    DateType,
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# The eight columns of a bank export, bound by position.
LEDGER_COLUMNS = (
    "Date",
    "Title",
    "Comment",
    "MainCategory",
    "Subcategory",
    "Account",
    "Amount",
    "Balance",
)
MONEY_COLUMNS = ("Amount", "Balance")
TEXT_COLUMNS = tuple(c for c in LEDGER_COLUMNS if c not in MONEY_COLUMNS)

# Selector sentinels and the two money flows.
ALL = "All"
ALL_MONTHS = "00"
EXPENSE = "Credit"
INCOME = "Debit"
DEFAULT_SEARCH_CATEGORY = "Food"

# Month codes and their labels.
MONTH_CODES = ("01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12")
MONTH_LABELS = {
    "00": "All",
    "01": "JAN",
    "02": "FEB",
    "03": "MAR",
    "04": "APR",
    "05": "MAY",
    "06": "JUN",
    "07": "JUL",
    "08": "AUG",
    "09": "SEP",
    "10": "OCT",
    "11": "NOV",
    "12": "DEC",
}

# Names of the series and label rows of the reports.
END_OF_MONTH = "End Of Month Balance"
NET_WORTH = "Net Worth"
EXPENSES = "Expenses"
INCOMES = "Income"
MONTHLY_SAVINGS = "Monthly Savings"
MONTHLY_AVERAGE = "Monthly Avg"
MEAN_OF_YEARS = "Mean of All Years"

# Names of the reports where all of them are in one table.
HISTORY = "History"
EXPENSE_SHARE, INCOME_SHARE = "Expense Share", "Income Share"
EXPENSE_BREAKDOWN, INCOME_BREAKDOWN = "Expense Breakdown", "Income Breakdown"

# Position of a row among all ingested lines, see functions.positions.
POSITION = "_position"

MONEY = DecimalType(18, 2)

RAW_SCHEMA = StructType([StructField(c, StringType()) for c in LEDGER_COLUMNS])


def table_schema(money: DecimalType = MONEY) -> StructType:
    """Schema of the stored ledger; ``Year`` is the partition column and stays text.

    Money has four decimals at most: means are exact up to there.
    """
    if money.scale > 4:
        raise ValueError(f"money of more than four decimals: {money.simpleString()}")
    columns = [
        StructField(c, money if c in MONEY_COLUMNS else StringType()) for c in LEDGER_COLUMNS
    ]
    return StructType(
        columns
        + [
            StructField("Month", StringType()),
            StructField("LedgerDate", DateType()),
            StructField(POSITION, LongType()),
            StructField("Year", StringType()),
        ]
    )
