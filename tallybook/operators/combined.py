"""The reports of one choice of selectors, from one pass over its postings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.balances import account_series, flow_amounts
from tallybook.operators.months import MONTH_KEY, with_month
from tallybook.schema import (
    ALL,
    ALL_MONTHS,
    END_OF_MONTH,
    EXPENSE,
    EXPENSE_BREAKDOWN,
    EXPENSE_SHARE,
    HISTORY,
    INCOME,
    INCOME_BREAKDOWN,
    INCOME_SHARE,
    MONTH_CODES,
    POSITION,
)

# What a wide row of twelve months stands for.
_OF_ACCOUNTS, _OF_CATEGORY, _OF_FLOW = 0, 10, 20


def selection_reports(selection: DataFrame, account: str, category: str, month: str) -> DataFrame:
    """History, shares and breakdowns of both flows (Report, Series, Month, Value).

    Grouping sets make the groups of all reports at once: postings are read and exchanged once,
    and what follows has a row for each account, category and month at most. The selection is that
    of the account, category, year and month without a flow.
    """
    everyone, whole_year = account == ALL, month == ALL_MONTHS
    keep = F.col("MainCategory") == category if everyone and category != ALL else None
    flows = flow_amounts(keep)
    counted = F.col("Balance").isNotNull()
    sets = [["Account", MONTH_KEY], ["Subcategory", "MainCategory", MONTH_KEY]]
    if not everyone and whole_year:
        sets.append(["Subcategory", MONTH_KEY])
    groups = (
        with_month(selection)
        .groupingSets(sets, "Account", "Subcategory", "MainCategory", MONTH_KEY)
        .agg(
            F.grouping("Account").alias("_no_account"),
            F.grouping("MainCategory").alias("_no_category"),
            F.max_by(
                "Balance", F.when(counted if keep is None else counted & keep, F.col(POSITION))
            ).alias("EndBalance"),
            *[F.sum(amount).alias(name) for name, amount in flows.items()],
            F.sum("Amount").alias("Amount"),
        )
    )
    money = f"DECIMAL(38,{selection.schema['Amount'].dataType.scale})"
    if everyone:
        history = account_series(money, f"'{HISTORY}' AS Report")
    else:
        history = f"""array(struct('{HISTORY}' AS Report, {_OF_ACCOUNTS} AS _kind,
            '{END_OF_MONTH}' AS Series, CAST(EndBalance AS {money}) AS Value))"""
    flow = f"CASE Subcategory WHEN '{EXPENSE}' THEN '{EXPENSE}' WHEN '{INCOME}' THEN '{INCOME}' END"
    of_category = f"""array(struct({flow} AS Report, {_OF_CATEGORY} AS _kind,
        MainCategory AS Series, CAST(Amount AS {money}) AS Value))"""
    of_flow = f"""array(struct({flow} AS Report, {_OF_FLOW} AS _kind,
        '{END_OF_MONTH}' AS Series, CAST(EndBalance AS {money}) AS Value))"""
    wide = (
        groups.selectExpr(
            MONTH_KEY,
            f"""inline(CASE WHEN _no_account = 0 THEN {history}
                WHEN _no_category = 0 THEN {of_category} ELSE {of_flow} END)""",
        )
        .where("Report IS NOT NULL")
        .groupBy("Report", "_kind", "Series")
        .pivot(MONTH_KEY, list(MONTH_CODES))
        .agg(F.sum("Value"))
    )
    return wide.select(F.inline(_reports(everyone, whole_year, month)))


def _reports(everyone: bool, whole_year: bool, month: str) -> Column:
    """The rows that come of a wide row."""
    kind, is_expense = F.col("_kind"), F.col("Report") == EXPENSE
    cells = {code: F.coalesce(F.col(code), F.lit(0)) for code in MONTH_CODES}
    total = F.abs(sum(list(cells.values())[1:], cells["01"])).cast("double")
    share = F.when(is_expense, EXPENSE_SHARE).otherwise(INCOME_SHARE)
    breakdown = F.when(is_expense, EXPENSE_BREAKDOWN).otherwise(INCOME_BREAKDOWN)

    def row(report: Column, code: str, value: Column) -> Column:
        return F.struct(
            report.alias("Report"),
            F.col("Series").alias("Series"),
            F.lit(code).alias("Month"),
            value.alias("Value"),
        )

    def months(report: Column) -> list[Column]:
        return [row(report, code, cell.cast("double")) for code, cell in cells.items()]

    of_category = [row(share, month, total)]
    if not whole_year:
        of_category.append(row(breakdown, month, total))
    elif everyone:
        of_category += months(breakdown)
    return (
        F.when(kind == _OF_CATEGORY, F.array(*of_category))
        .when(kind == _OF_FLOW, F.array(*months(breakdown)))
        .otherwise(F.array(*months(F.col("Report"))))
    )
