"""A ledger boiled down to what the reports need."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallybook.functions.dates import split_month, split_year
from tallybook.schema import MONEY_COLUMNS, POSITION, table_schema

_KEYS = ("Year", "Month", "_m", "_y", "Account", "MainCategory", "Subcategory")
# What the postings of a group share.
GROUP = ("Year", "Month", "Date", "Account", "MainCategory", "Subcategory")
_VALUES = ("Amount", "Balance", POSITION, "_last")

# The position of a group's last line, whether it has a balance or not.
LAST = "_last"


def condense(ledger: DataFrame) -> DataFrame:
    """One posting per month, account, category and money flow, in ingest order.

    Its amount is the sum, its balance and position are those of the last line that has a
    balance. All selectors and reports give the same answers on it as on the ledger; row views
    do not, and neither does ``order="date"``. Written once with ``write_table``, it spares the
    reports from reading the postings again each time.
    """
    return condensed_state(ledger).drop(LAST)


def condensed_state(ledger: DataFrame) -> DataFrame:
    """The condensed ledger with what it takes to merge further lines into it."""
    money = ledger.schema["Amount"].dataType
    # What a sum of such amounts fits in.
    wide = DecimalType(min(money.precision + 10, 38), money.scale)
    date = F.col("Date")
    counted = F.when(F.col("Balance").isNotNull(), F.col(POSITION))
    groups = (
        ledger.withColumns({"_m": split_month(date), "_y": split_year(date)})
        .groupBy(*_KEYS)
        .agg(
            F.max_by("Balance", counted).alias("Balance"),
            F.max(counted).alias("_counted"),
            F.max(POSITION).alias(LAST),
            F.sum("Amount").alias("Amount"),
        )
    )
    return groups.withColumns(
        {
            "Date": F.concat_ws("/", "_m", F.lit("01"), "_y"),
            "Title": F.lit(""),
            "Comment": F.lit(""),
            "LedgerDate": F.lit(None).cast("date"),
            POSITION: F.col("_counted"),
            **{c: F.col(c).cast(wide) for c in MONEY_COLUMNS},
        }
    ).select(*table_schema().names, LAST)


def merge_states(state: DataFrame, new: DataFrame, first: int) -> DataFrame:
    """The state of all lines, from that of some and that of the lines from position ``first`` on.

    A group whose last line is one of the new ones has taken them in already, by an earlier merge
    that may have ended halfway; it stays as it is.
    """
    both = state.withColumn("_new", F.lit(False)).unionByName(
        new.withColumn("_new", F.lit(True))
    )
    # Each side has one row of a group at most.
    sides = {
        f"{side}{column}": F.max(F.when(F.col("_new") == (side == "_n"), F.col(column)))
        for side in ("_o", "_n")
        for column in _VALUES
    }
    groups = both.groupBy(*GROUP).agg(*[value.alias(name) for name, value in sides.items()])
    taken = F.col(f"_o{LAST}").isNull() | (F.col(f"_o{LAST}") < first)
    closing = taken & F.col(f"_n{POSITION}").isNotNull()
    added = F.coalesce(F.col("_oAmount") + F.col("_nAmount"), F.col("_oAmount"), F.col("_nAmount"))
    values = {
        "Amount": F.when(taken, added).otherwise(F.col("_oAmount")),
        "Balance": F.when(closing, F.col("_nBalance")).otherwise(F.col("_oBalance")),
        POSITION: F.when(closing, F.col(f"_n{POSITION}")).otherwise(F.col(f"_o{POSITION}")),
        LAST: F.greatest(f"_o{LAST}", f"_n{LAST}"),
    }
    types = {f.name: f.dataType for f in state.schema.fields}
    return groups.withColumns(
        {
            **{c: value.cast(types[c]) for c, value in values.items()},
            "Title": F.lit(""),
            "Comment": F.lit(""),
            "LedgerDate": F.lit(None).cast("date"),
        }
    ).select(*state.columns)
