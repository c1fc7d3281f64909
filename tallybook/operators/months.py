"""The twelve-month form of monthly aggregates, zero where nothing was posted."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import month_code
from tallybook.schema import MONTH_CODES

MONTH_KEY = "_month"


def with_month(rows: DataFrame) -> DataFrame:
    """Add the month a posting belongs to, whether its date is padded or not."""
    return rows.withColumn(MONTH_KEY, month_code(F.col("Date")))


def twelve_months(
    rows: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Aggregates per key and month, twelve rows for every key that occurs.

    The pivot aggregates by key and month before it gathers the months of a key in one row, so
    only groups are spread out. Where no row goes in, none comes out, also without keys:
    grouping by a constant, unlike grouping by nothing, gives no row for no input.
    """
    groups = [F.col(key) for key in keys] or [F.lit(True).alias("_whole")]
    wide = (
        rows.groupBy(*groups)
        .pivot(MONTH_KEY, list(MONTH_CODES))
        .agg(*[measure.alias(name) for name, measure in measures.items()])
    )
    # Spark puts the measure's name into a pivoted column only where there are several.
    pivoted = "`{month}_{name}`" if len(measures) > 1 else "`{month}`"
    months = ", ".join(
        f"struct('{month}' AS Month, "
        + ", ".join(
            f"coalesce({pivoted.format(month=month, name=name)}, 0) AS {name}"
            for name in measures
        )
        + ")"
        for month in MONTH_CODES
    )
    return wide.selectExpr(*keys, f"inline(array({months}))")
