"""A ledger made from the order tables: one posting per order, the customer's segment as account."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.schema import EXPENSE, INCOME, POSITION
from tallybook.sources.exports import with_period

# The columns that are read, so that no file has to be opened to find them out.
ORDERS = """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
    o_orderdate timestamp_ntz, o_orderpriority string"""
CUSTOMERS = "c_custkey bigint, c_acctbal double, c_mktsegment string"

# Rows of this ledger have no file position; the day and the key of the order make one.
_KEY_BITS = 43
_FIRST_DAY, _LAST_DAY = "0001-01-01", "2800-01-01"  # days that fit above the key

_POSTING = (
    "concat(substring(_iso, 6, 2), '/', substring(_iso, 9, 2), '/', substring(_iso, 1, 4)) AS Date",
    "concat('Order#', o_orderkey) AS Title",
    "'' AS Comment",
    "o_orderpriority AS MainCategory",
    f"""CASE o_orderstatus WHEN 'F' THEN '{EXPENSE}' WHEN 'O' THEN '{INCOME}'
        ELSE 'Transfer' END AS Subcategory""",
    "c_mktsegment AS Account",
    """CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END
        AS DECIMAL(18,2)) AS Amount""",
    "CAST(c_acctbal AS DECIMAL(18,2)) AS Balance",
    "_d AS LedgerDate",
    f"""CASE WHEN _d BETWEEN DATE'{_FIRST_DAY}' AND DATE'{_LAST_DAY}'
          AND o_orderkey BETWEEN 0 AND {(1 << _KEY_BITS) - 1}
        THEN shiftleft(CAST(datediff(_d, DATE'{_FIRST_DAY}') AS BIGINT), {_KEY_BITS}) + o_orderkey
        WHEN _d IS NULL OR o_orderkey IS NULL THEN NULL
        ELSE raise_error('no place for this day and order') END AS {POSITION}""",
)


def order_ledger(
    spark: SparkSession, directory: str, year: str | None = None, month: str | None = None
) -> DataFrame:
    """Typed ledger over the order tables of a directory, of all years, of one or of its month.

    A given year or month becomes a range over the order date, which reaches the parquet scan;
    the text comparison of the selectors cannot.
    """
    orders = read_orders(spark, directory)
    if year is not None:
        first = date(int(year), int(month or 1), 1)
        months = 12 if month is None else 1
        years, past = divmod(first.month - 1 + months, 12)
        beyond = date(first.year + years, past + 1, 1)
        orders = orders.where(between(first.isoformat(), beyond.isoformat()))
    return post(orders, read_customers(spark, directory))


def between(first: str | None, after: str | None) -> str:
    """A condition on the order date: from a day on, before another; open where one is missing."""
    ends = [f"o_orderdate >= TIMESTAMP_NTZ'{first}'"] if first else []
    ends += [f"o_orderdate < TIMESTAMP_NTZ'{after}'"] if after else []
    return " AND ".join(ends)


def read_orders(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(f"{directory}/orders.parquet")


def read_customers(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(CUSTOMERS).parquet(f"{directory}/customer.parquet")


def post(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders to postings.

    The join carries no broadcast hint: Spark broadcasts the customers below its size threshold,
    and splits hot customers of a sort-merge join otherwise.
    """
    postings = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .selectExpr("*", "CAST(o_orderdate AS DATE) AS _d")
        .selectExpr("*", "CAST(_d AS STRING) AS _iso")
    )
    return with_period(postings.selectExpr(*_POSTING))
