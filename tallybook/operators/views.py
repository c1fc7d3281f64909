"""Row views: which columns of a selection are shown, in which order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallybook.functions import dates
from tallybook.schema import (
    ALL,
    ALL_MONTHS,
    DEFAULT_SEARCH_CATEGORY,
    EXPENSE,
    INCOME,
    POSITION,
)
from tallybook.operators.selection import select_category, select_transactions

_TAIL = ("Account", "Title", "MainCategory", "Amount", "Balance")


def transactions(
    ledger: DataFrame,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
    positions: bool = False,
) -> DataFrame:
    return _dated(select_transactions(ledger, account, category, year, month), _TAIL, positions)


def expenses(
    ledger: DataFrame,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
    positions: bool = False,
) -> DataFrame:
    return _dated(select_transactions(ledger, account, category, year, month, EXPENSE), _TAIL, positions)


def income(
    ledger: DataFrame,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
    positions: bool = False,
) -> DataFrame:
    return _dated(select_transactions(ledger, account, category, year, month, INCOME), _TAIL, positions)


def category_rows(
    ledger: DataFrame, category: str = DEFAULT_SEARCH_CATEGORY, positions: bool = False
) -> DataFrame:
    """All years of one category, without the balance."""
    return _dated(select_category(ledger, category), _TAIL[:-1], positions)


def transactions_as_text(
    ledger: DataFrame,
    account: str = ALL,
    category: str = ALL,
    year: str | None = None,
    month: str = ALL_MONTHS,
) -> DataFrame:
    """The older layout: the date in one piece and money as text.

    A ledger of raw rows (``with_period``) shows the text of the export itself.
    """
    return select_transactions(ledger, account, category, year, month).select(
        "Date",
        "Account",
        "Title",
        "MainCategory",
        F.col("Amount").cast("string").alias("Amount"),
        F.col("Balance").cast("string").alias("Balance"),
    )


def arrange(
    view: DataFrame,
    where: Column | str | None = None,
    order_by: Sequence[Column | str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Filter and order a view by any of its columns, and keep the first rows if asked to."""
    if where is not None:
        view = view.where(where)
    if order_by:
        view = view.orderBy(*order_by)
    return view if limit is None else view.limit(limit)


def page(
    view: DataFrame,
    order_by: Sequence[str],
    size: int,
    after: Sequence[object] | None = None,
) -> DataFrame:
    """The first rows of a view in that order, or those that follow where a page ended.

    ``order_by`` names columns, ``-`` before a name turns it round; equal rows go by position, which
    the view must have. As in any Spark order, missing values come first, and last where it is
    turned round. ``after`` is what ``page_end`` gives for the last page. Every page reads no more
    than its rows into the result, however far down it is.
    """
    keys = _page_keys(order_by)
    if after is not None:
        if len(after) != len(keys):
            raise ValueError(f"a page ends with {len(keys)} values, these are {len(after)}")
        same, beyond = F.lit(True), F.lit(False)
        for (name, down), value in zip(keys, after):
            column = F.col(name)
            if value is None:
                further = F.lit(False) if down else column.isNotNull()
            else:
                further = (column < value) | column.isNull() if down else column > value
            beyond |= same & further
            same &= column.eqNullSafe(F.lit(value))
        view = view.where(beyond)
    order = [F.col(name).desc() if down else F.col(name).asc() for name, down in keys]
    return view.orderBy(*order).limit(size)


def page_end(rows: Sequence[Row], order_by: Sequence[str]) -> tuple | None:
    """Where a page ended, to go on from; nothing for a page without rows."""
    return tuple(rows[-1][name] for name, _ in _page_keys(order_by)) if rows else None


def _page_keys(order_by: Sequence[str]) -> list[tuple[str, bool]]:
    keys = [(name.removeprefix("-"), name.startswith("-")) for name in order_by]
    return [*keys, (POSITION, False)]


def records(view: DataFrame) -> DataFrame:
    """One JSON object per row, missing cells as null."""
    cells = F.struct(*[F.col(c) for c in view.columns])
    return view.select(F.to_json(cells, {"ignoreNullFields": "false"}).alias("json"))


def _dated(selection: DataFrame, columns: Sequence[str], positions: bool = False) -> DataFrame:
    """The columns of a view; with positions, it can be shown in pages."""
    date = F.col("Date")
    return selection.select(
        dates.split_month(date).alias("Month"),
        dates.split_day(date).alias("Day"),
        dates.split_year(date).alias("Year"),
        *columns,
        *([POSITION] if positions else []),
    )
