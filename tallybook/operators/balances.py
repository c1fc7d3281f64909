"""Month-end balances, monthly flows and net worth."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.months import MONTH_KEY, twelve_months, with_month
from tallybook.schema import (
    ALL,
    EXPENSE,
    EXPENSES,
    INCOME,
    INCOMES,
    MONTHLY_SAVINGS,
    NET_WORTH,
    POSITION,
)

Order = str | Sequence[str]


def month_end_balance(selection: DataFrame, order: Order = "ingest") -> DataFrame:
    """Balance on the last row of each month, over the selection as a whole.

    ``order`` decides which row is last: ``ingest`` is the order of the export's lines, ``date``
    puts the posting date first, and a list of columns sorts by those (unique together). One or
    two plain columns need no sort.
    """
    return _monthly(_closing(selection, [], order), [], ["EndBalance"])


def account_month_balance(selection: DataFrame, order: Order = "ingest") -> DataFrame:
    """Month-end balance per account."""
    keys = ["Account"]
    return _monthly(_closing(selection, keys, order), keys, ["EndBalance"])


def account_month_flows(selection: DataFrame) -> DataFrame:
    """Monthly sums of credits and of debits per account."""
    flows = {name: F.sum(amount) for name, amount in flow_amounts().items()}
    return twelve_months(with_month(selection), ["Account"], flows)


def net_worth_monthly(selection: DataFrame, order: Order = "ingest") -> DataFrame:
    """Across accounts, per month: month-end balances, credits, debits and what is left of them."""
    accounts = _closing(selection, ["Account"], order, sums=flow_amounts())
    return _monthly(accounts, [], ["EndBalance", "Credit", "Debit"]).selectExpr(
        "Month",
        "EndBalance AS NetWorth",
        "Credit AS Expenses",
        "Debit AS Income",
        "Credit + Debit AS MonthlySavings",
    )


def account_history(
    selection: DataFrame, category: str = ALL, order: Order = "ingest"
) -> DataFrame:
    """Month-end balance of every account, and the four series across accounts.

    Every account of the selection has a series; the category narrows only what is counted in it.
    """
    keep = None if category == ALL else F.col("MainCategory") == category
    accounts = _closing(selection, ["Account"], order, keep, flow_amounts(keep))
    spread = accounts.selectExpr(MONTH_KEY, f"inline({account_series()})")
    return _monthly(spread, ["_kind", "Series"], ["Value"]).drop("_kind")


def _monthly(groups: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return twelve_months(groups, keys, {m: F.sum(m) for m in measures})


def account_series(money: str | None = None, *more: str) -> str:
    """The series that an account's month counts in: its own, and the four across accounts.

    As SQL for an array of structs. The kind keeps an account called like a total apart from it.
    """
    series = (
        (0, "Account", "EndBalance"),
        (1, f"'{NET_WORTH}'", "EndBalance"),
        (2, f"'{EXPENSES}'", "Credit"),
        (3, f"'{INCOMES}'", "Debit"),
        (4, f"'{MONTHLY_SAVINGS}'", "Credit"),
        (4, f"'{MONTHLY_SAVINGS}'", "Debit"),
    )
    structs = []
    for kind, name, value in series:
        value = f"CAST({value} AS {money})" if money else value
        cells = [*more, f"{kind} AS _kind", f"{name} AS Series", f"{value} AS Value"]
        structs.append(f"struct({', '.join(cells)})")
    return f"array({', '.join(structs)})"


def flow_amounts(keep: Column | None = None) -> dict[str, Column]:
    """Amounts of credits and of debits, of the postings that are kept."""
    flow = F.col("Subcategory")
    credit, debit = flow == EXPENSE, flow == INCOME
    if keep is not None:
        credit, debit = credit & keep, debit & keep
    return {"Credit": F.when(credit, F.col("Amount")), "Debit": F.when(debit, F.col("Amount"))}


def _closing(
    selection: DataFrame,
    keys: list[str],
    order: Order,
    keep: Column | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Last balance, and sums, per key and month; NULL where nothing is kept.

    The position is one plain column, which hash aggregation can update in place. With more order
    columns there are two steps: the last row within each day, then the last of those. One
    ``max_by`` over a struct of all columns would sort the whole input by group instead.
    """
    *outer, inner = _order_columns(order)
    steps = [f"_step{i}" for i in range(len(outer))]
    counted = F.col("Balance").isNotNull()
    if keep is not None:
        counted &= keep
    sums = sums or {}
    within = (
        with_month(selection)
        .groupBy(*keys, MONTH_KEY, *[o.alias(s) for o, s in zip(outer, steps)])
        .agg(
            F.max_by("Balance", F.when(counted, inner)).alias("EndBalance"),
            *[F.sum(amount).alias(name) for name, amount in sums.items()],
        )
    )
    if not steps:
        return within
    latest = F.col(steps[0]) if len(steps) == 1 else F.struct(*steps)
    closed = F.col("EndBalance").isNotNull()
    return within.groupBy(*keys, MONTH_KEY).agg(
        F.max_by("EndBalance", F.when(closed, latest)).alias("EndBalance"),
        *[F.sum(name).alias(name) for name in sums],
    )


def _order_columns(order: Order) -> list[Column]:
    if order == "ingest":
        return [F.col(POSITION)]
    if order == "date":
        # A text that is no date comes first, as it has no place of its own.
        day = F.coalesce(F.col("LedgerDate"), F.lit("0001-01-01").cast("date"))
        return [day, F.col(POSITION)]
    if isinstance(order, str) or not order:
        raise ValueError(f"order is 'ingest', 'date' or some columns: {order!r}")
    return [F.col(c) for c in order]
