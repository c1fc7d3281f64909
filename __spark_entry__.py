"""

All queries run over the ledger that ``orders`` and ``customer`` make up (see
``tallybook/sources/orders.py``), with the fixed parameters below.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import dates
from tallybook.functions.money import money_as_double, round_to_one_digit
from tallybook.operators import balances, dimensions, totals, views
from tallybook.operators.condense import condense
from tallybook.operators.selection import select_category, select_transactions
from tallybook.plans import reports
from tallybook.schema import ALL, EXPENSE, INCOME, LEDGER_COLUMNS, MONTH_CODES
from tallybook.sources.exports import union_all
from tallybook.sources.orders import between, order_ledger, post, read_customers, read_orders
from tallybook.sources.sql import fetch, register

Query = Callable[[SparkSession, str], DataFrame]

YEAR = "1998"
SHORT_YEAR = "2001"  # has postings in eight months only
ACCOUNT = "BUILDING"
CATEGORY = "5-LOW"
MONTH = "03"


def entry(spark: SparkSession) -> DataFrame:
    return _net_worth_monthly(spark, "/root/testdata/sf0.001")


# --- queries ---------------------------------------------------------------------------------


def _ledger_rows(ledger: DataFrame) -> DataFrame:
    return money_as_double(ledger.select(*LEDGER_COLUMNS))


def _selected(**selectors: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = order_ledger(spark, sf_dir, YEAR, selectors.get("month"))
        return _ledger_rows(select_transactions(ledger, year=YEAR, **selectors))

    return query


def _ledger_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_orders(spark, sf_dir)
    # Ranges of days that together are all rows: each part reads its own days only.
    parts = [between(None, "1997-01-01"), between("1997-01-01", "1999-01-01"),
             between("1999-01-01", None), "o_orderdate IS NULL"]
    union = union_all(*[orders.where(part) for part in parts])
    return _ledger_rows(post(union, read_customers(spark, sf_dir)))


def _ledger_sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(order_ledger(spark, sf_dir, YEAR))
    rows = fetch(
        spark,
        "SELECT * FROM ledger"
        " WHERE MainCategory = :category AND substring(`Date`, 7, 4) = :year",
        category=CATEGORY,
        year=YEAR,
    )
    return _ledger_rows(rows)


def _date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("Date")
    return (
        order_ledger(spark, sf_dir)
        .select("Date")
        .distinct()
        .select(
            "Date",
            dates.year_text(date).alias("Year"),
            dates.month_text(date).alias("Month"),
            dates.split_day(date).alias("Day"),
            dates.month_index(date).alias("MonthIndex"),
        )
    )


def _month_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.months_in_use(order_ledger(spark, sf_dir))


def _round_sig1(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("Amount")
    ledger = order_ledger(spark, sf_dir).where(amount != 0)
    return ledger.select("Title", round_to_one_digit(amount).alias("Sig1"))


def _tx_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger_rows(select_category(order_ledger(spark, sf_dir), CATEGORY))


def _dim_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.accounts(order_ledger(spark, sf_dir))


def _dim_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.categories(order_ledger(spark, sf_dir))


def _dim_account_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.account_categories(order_ledger(spark, sf_dir), ACCOUNT)


def _dim_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.years(order_ledger(spark, sf_dir))


def _by_category(flow: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.flow_share(order_ledger(spark, sf_dir, YEAR), flow, year=YEAR)

    return query


def _category_bar(flow: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = order_ledger(spark, sf_dir, YEAR, MONTH)
        return reports.flow_breakdown(ledger, flow, year=YEAR, month=MONTH)

    return query


def _short_year(spark: SparkSession, sf_dir: str, **selectors: str) -> DataFrame:
    ledger = order_ledger(spark, sf_dir, SHORT_YEAR)
    return select_transactions(ledger, year=SHORT_YEAR, **selectors)


def _month_end_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = _short_year(spark, sf_dir, account=ACCOUNT)
    return money_as_double(balances.month_end_balance(selection))


def _flow_month_end_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = _short_year(spark, sf_dir, account=ACCOUNT, flow=EXPENSE)
    return money_as_double(balances.month_end_balance(selection))


def _account_month_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money_as_double(
        balances.account_month_balance(_short_year(spark, sf_dir))
    )


def _account_month_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money_as_double(balances.account_month_flows(_short_year(spark, sf_dir)))


def _net_worth_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money_as_double(balances.net_worth_monthly(_short_year(spark, sf_dir)))


def _category_month(flow: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return money_as_double(totals.category_month_sums(_short_year(spark, sf_dir, flow=flow)))

    return query


def _category_year_month_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = select_category(order_ledger(spark, sf_dir), CATEGORY)
    return money_as_double(totals.year_month_pivot(selection))


def _category_monthly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = totals.monthly_mean(select_category(order_ledger(spark, sf_dir), CATEGORY))
    return means.select(*[F.round(c, 2).alias(c) for c in means.columns])


def _category_year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_years(order_ledger(spark, sf_dir), CATEGORY)


def _report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = order_ledger(spark, sf_dir, SHORT_YEAR)
    return reports.history(ledger, category=CATEGORY, year=SHORT_YEAR)


def _report_history_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = order_ledger(spark, sf_dir, SHORT_YEAR)
    return reports.history(ledger, ACCOUNT, CATEGORY, SHORT_YEAR)


def _report_history_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = condense(order_ledger(spark, sf_dir, SHORT_YEAR))
    return reports.history(months, category=CATEGORY, year=SHORT_YEAR)


def _report_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = order_ledger(spark, sf_dir, SHORT_YEAR)
    return reports.selection_reports(ledger, category=CATEGORY, year=SHORT_YEAR)


def _report_breakdown(**selectors: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = order_ledger(spark, sf_dir, SHORT_YEAR)
        return reports.flow_breakdown(ledger, EXPENSE, year=SHORT_YEAR, **selectors)

    return query


def _report_category_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = reports.category_seasonality(order_ledger(spark, sf_dir), CATEGORY)
    return series.withColumn("Value", F.round("Value", 2))


def _view(view: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return money_as_double(view(order_ledger(spark, sf_dir, YEAR), ACCOUNT, year=YEAR))

    return query


def _view_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money_as_double(views.category_rows(order_ledger(spark, sf_dir), CATEGORY))


def _view_sorted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = views.transactions(order_ledger(spark, sf_dir, YEAR), ACCOUNT, year=YEAR)
    return money_as_double(views.arrange(view, order_by=[F.desc("Amount"), "Title"], limit=10))


def _records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = order_ledger(spark, sf_dir, YEAR, MONTH)
    return views.records(views.transactions(ledger, ACCOUNT, ALL, YEAR, MONTH))


def queries() -> dict[str, Query]:
    found = ledger_queries()
    for module in _training_data():
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found = ledger_oracle_sql()
    for module in _training_data():
        found |= module.oracle_sql()
    return found


def _training_data() -> list[ModuleType]:
    """The query modules of the training-data pipeline, those that are installed."""
    found = []
    for name in ("tallybook.llm.queries", "corpus_pipeline"):
        try:
            found.append(import_module(name))
        except ModuleNotFoundError as missing:
            if missing.name not in ("tallybook.llm", "tallybook.llm.queries", "corpus_pipeline"):
                raise
    return found


def ledger_queries() -> dict[str, Query]:
    return {
        "ledger_union_all": _ledger_union_all,
        "ledger_sql_scan": _ledger_sql_scan,
        "date_parts": _date_parts,
        "month_dim": _month_dim,
        "round_sig1": _round_sig1,
        "tx_year": _selected(),
        "tx_year_month": _selected(month=MONTH),
        "tx_account": _selected(account=ACCOUNT),
        "tx_account_month": _selected(account=ACCOUNT, month=MONTH),
        "tx_account_category": _selected(account=ACCOUNT, category=CATEGORY),
        "tx_account_category_month": _selected(
            account=ACCOUNT, category=CATEGORY, month=MONTH
        ),
        "tx_flow_year": _selected(flow=EXPENSE),
        "tx_flow_year_month": _selected(flow=EXPENSE, month=MONTH),
        "tx_flow_account": _selected(flow=EXPENSE, account=ACCOUNT),
        "tx_flow_account_month": _selected(flow=EXPENSE, account=ACCOUNT, month=MONTH),
        "tx_flow_account_category": _selected(
            flow=EXPENSE, account=ACCOUNT, category=CATEGORY
        ),
        "tx_flow_account_category_month": _selected(
            flow=EXPENSE, account=ACCOUNT, category=CATEGORY, month=MONTH
        ),
        "tx_by_category": _tx_by_category,
        "dim_accounts": _dim_accounts,
        "dim_categories": _dim_categories,
        "dim_account_categories": _dim_account_categories,
        "dim_years": _dim_years,
        "expense_by_category": _by_category(EXPENSE),
        "income_by_category": _by_category(INCOME),
        "category_bar_expense": _category_bar(EXPENSE),
        "category_bar_income": _category_bar(INCOME),
        "month_end_balance": _month_end_balance,
        "flow_month_end_balance": _flow_month_end_balance,
        "account_month_balance": _account_month_balance,
        "account_month_flows": _account_month_flows,
        "net_worth_monthly": _net_worth_monthly,
        "category_month_expense": _category_month(EXPENSE),
        "category_month_income": _category_month(INCOME),
        "category_year_month_pivot": _category_year_month_pivot,
        "category_monthly_mean": _category_monthly_mean,
        "category_year_totals": _category_year_totals,
        "report_history": _report_history,
        "report_history_account": _report_history_account,
        "report_history_condensed": _report_history_condensed,
        "report_selection": _report_selection,
        "report_breakdown_year": _report_breakdown(),
        "report_breakdown_account": _report_breakdown(account=ACCOUNT),
        "report_category_seasonality": _report_category_seasonality,
        "view_transactions": _view(views.transactions),
        "view_expenses": _view(views.expenses),
        "view_income": _view(views.income),
        "view_category": _view_category,
        "view_transactions_raw": _view(views.transactions_as_text),
        "view_sorted_top": _view_sorted_top,
        "records_json": _records_json,
    }


# --- oracle ----------------------------------------------------------------------------------

_LEDGER_SQL = """
ledger AS (
  SELECT strftime(o_orderdate, '%m/%d/%Y') AS "Date",
         concat('Order#', o_orderkey) AS Title,
         '' AS Comment,
         o_orderpriority AS MainCategory,
         CASE o_orderstatus WHEN 'F' THEN 'Credit' WHEN 'O' THEN 'Debit' ELSE 'Transfer' END
           AS Subcategory,
         c_mktsegment AS Account,
         CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END
              AS DECIMAL(18,2)) AS Amount,
         CAST(c_acctbal AS DECIMAL(18,2)) AS Balance,
         o_orderdate AS _d, o_orderkey AS _k
  FROM orders JOIN customer ON o_custkey = c_custkey),
months AS (SELECT lpad(CAST(range AS VARCHAR), 2, '0') AS Month FROM range(1, 13))
"""

_ROWS = (
    '"Date", Title, Comment, MainCategory, Subcategory, Account,'
    " CAST(Amount AS DOUBLE) AS Amount, CAST(Balance AS DOUBLE) AS Balance"
)
_PARTS = (
    """split_part("Date", '/', 1) AS Month, split_part("Date", '/', 2) AS Day,"""
    """ split_part("Date", '/', 3) AS Year, Account, Title, MainCategory"""
)
_VIEW = f"{_PARTS}, CAST(Amount AS DOUBLE) AS Amount, CAST(Balance AS DOUBLE) AS Balance"
_Y = """substr("Date", 7, 4)"""
_M = """substr("Date", 1, 2)"""
_IN_YEAR = f"{_Y} = '{YEAR}'"
_IN_SHORT = f"{_Y} = '{SHORT_YEAR}'"
_IN_MONTH = f"{_M} = '{MONTH}'"
_OF_ACCOUNT = f"Account = '{ACCOUNT}'"
_OF_CATEGORY = f"MainCategory = '{CATEGORY}'"
_LAST = "max_by(Balance, row(_d, _k))"


def _sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([_LEDGER_SQL, *ctes]) + select


def _where(*conditions: str) -> str:
    return _sql(f"SELECT {_ROWS} FROM ledger WHERE " + " AND ".join(conditions))


def _flow(flow: str) -> str:
    return f"Subcategory = '{flow}'"


def _dim_sql(column: str, condition: str = "TRUE") -> str:
    return _sql(
        f"SELECT DISTINCT {column} AS value FROM ledger WHERE {condition}"
        " UNION ALL SELECT 'All' AS value"
    )


def _share_sql(flow: str) -> str:
    return _sql(
        "SELECT MainCategory, CAST(abs(sum(Amount)) AS DOUBLE) AS CategorySum"
        f" FROM ledger WHERE {_IN_YEAR} AND {_flow(flow)} GROUP BY MainCategory"
    )


def _bar_sql(flow: str) -> str:
    return _sql(
        "SELECT MainCategory AS CategoryName, CAST(abs(sum(Amount)) AS DOUBLE) AS CategorySum"
        f" FROM ledger WHERE {_IN_YEAR} AND {_IN_MONTH} AND {_flow(flow)} GROUP BY MainCategory"
    )


def _month_end_sql(*conditions: str) -> str:
    return _sql(
        "SELECT months.Month AS Month, CAST(coalesce(b, 0) AS DOUBLE) AS EndBalance"
        " FROM months LEFT JOIN ends ON months.Month = ends.Month",
        f" ends AS (SELECT {_M} AS Month, {_LAST} AS b FROM ledger"
        f" WHERE {' AND '.join(conditions)} GROUP BY 1)",
    )


_ACCOUNT_MONTHS = f""" cells AS (
  SELECT Account, {_M} AS Month, {_LAST} AS b,
         sum(Amount) FILTER (WHERE Subcategory = 'Credit') AS c,
         sum(Amount) FILTER (WHERE Subcategory = 'Debit') AS d
  FROM ledger WHERE {_IN_SHORT} GROUP BY 1, 2),
keys AS (SELECT DISTINCT Account FROM ledger WHERE {_IN_SHORT}),
grid AS (SELECT keys.Account AS Account, months.Month AS Month,
                coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d
         FROM keys CROSS JOIN months
         LEFT JOIN cells ON cells.Account = keys.Account AND cells.Month = months.Month)"""

# The account list comes from the whole year, the values from one category of it.
_HISTORY = f""" cells AS (
  SELECT Account, {_M} AS Month, {_LAST} AS b,
         sum(Amount) FILTER (WHERE Subcategory = 'Credit') AS c,
         sum(Amount) FILTER (WHERE Subcategory = 'Debit') AS d
  FROM ledger WHERE {_IN_SHORT} AND {_OF_CATEGORY} GROUP BY 1, 2),
keys AS (SELECT DISTINCT Account FROM ledger WHERE {_IN_SHORT}),
grid AS (SELECT keys.Account AS Account, months.Month AS Month,
                coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d
         FROM keys CROSS JOIN months
         LEFT JOIN cells ON cells.Account = keys.Account AND cells.Month = months.Month),
series AS (
  SELECT Account AS Series, Month, b AS v FROM grid
  UNION ALL SELECT 'Net Worth', Month, sum(b) FROM grid GROUP BY Month
  UNION ALL SELECT 'Expenses', Month, sum(c) FROM grid GROUP BY Month
  UNION ALL SELECT 'Income', Month, sum(d) FROM grid GROUP BY Month
  UNION ALL SELECT 'Monthly Savings', Month, sum(c) + sum(d) FROM grid GROUP BY Month)"""


_FLOW_MONTHS = f""" flow_cells AS (
  SELECT CASE Subcategory WHEN 'Credit' THEN 'Expense' ELSE 'Income' END AS flow, MainCategory,
         {_M} AS Month, sum(Amount) AS s
  FROM ledger WHERE {_IN_SHORT} AND Subcategory IN ('Credit', 'Debit') GROUP BY ALL),
flow_keys AS (SELECT DISTINCT flow, MainCategory FROM flow_cells),
flow_grid AS (
  SELECT flow_keys.flow AS flow, flow_keys.MainCategory AS Series, months.Month AS Month,
         coalesce(s, 0) AS s
  FROM flow_keys CROSS JOIN months
  LEFT JOIN flow_cells ON flow_cells.flow = flow_keys.flow AND flow_cells.Month = months.Month
                       AND flow_cells.MainCategory = flow_keys.MainCategory)"""
_SELECTION = """
SELECT 'History' AS Report, Series, Month, CAST(v AS DOUBLE) AS Value FROM series
UNION ALL SELECT flow || ' Breakdown', Series, Month, CAST(s AS DOUBLE) FROM flow_grid
UNION ALL SELECT flow || ' Share', Series, '00', CAST(abs(sum(s)) AS DOUBLE)
FROM flow_grid GROUP BY flow, Series"""


def _category_month_sql(flow: str) -> str:
    return _sql(
        "SELECT keys.MainCategory AS MainCategory, months.Month AS Month,"
        " CAST(coalesce(s, 0) AS DOUBLE) AS Amount FROM keys CROSS JOIN months"
        " LEFT JOIN cells ON cells.MainCategory = keys.MainCategory"
        " AND cells.Month = months.Month",
        f" picked AS (SELECT * FROM ledger WHERE {_IN_SHORT} AND {_flow(flow)})",
        f" cells AS (SELECT MainCategory, {_M} AS Month, sum(Amount) AS s"
        " FROM picked GROUP BY 1, 2)",
        " keys AS (SELECT DISTINCT MainCategory FROM picked)",
    )


_PIVOT = (
    f" pivoted AS (SELECT {_Y} AS Year, "
    + ", ".join(
        f"coalesce(sum(Amount) FILTER (WHERE {_M} = '{code}'), 0) AS m{code}"
        for code in MONTH_CODES
    )
    + f" FROM ledger WHERE {_OF_CATEGORY} GROUP BY 1)"
)
_MEANS = ", ".join(
    f"round(sum(CAST(m{code} AS DOUBLE)) / count(*), 2) AS m{code}" for code in MONTH_CODES
)
_SEASONS = f""" cells AS (
  SELECT {_Y} AS Year, {_M} AS Month, sum(Amount) AS s FROM ledger
  WHERE {_OF_CATEGORY} GROUP BY 1, 2),
years AS (SELECT DISTINCT Year FROM cells),
grid AS (SELECT years.Year AS Year, months.Month AS Month, coalesce(s, 0) AS s
         FROM years CROSS JOIN months
         LEFT JOIN cells ON cells.Year = years.Year AND cells.Month = months.Month)"""
_YEAR_SUMS = (
    f" sums AS (SELECT {_Y} AS Year, sum(Amount) AS s FROM ledger"
    f" WHERE {_OF_CATEGORY} GROUP BY 1)"
)
# The reports over one year of orders, from the tables themselves: the last row of a month by its
# rank, months without rows by a list of all twelve.
_TWELVE = "(SELECT unnest(range(1, 13)) AS n) AS twelve"


def _closing_sql(condition: str) -> str:
    return f"""
SELECT 'End Of Month Balance' AS Series, lpad(twelve.n::VARCHAR, 2, '0') AS Month,
       coalesce(last.c_acctbal, 0.0) AS Value
FROM {_TWELVE} LEFT JOIN (
  SELECT month(o_orderdate) AS n, c_acctbal FROM orders, customer
  WHERE c_custkey = o_custkey AND year(o_orderdate) = {SHORT_YEAR} AND {condition}
  QUALIFY row_number() OVER (PARTITION BY month(o_orderdate)
                             ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1
) AS last ON last.n = twelve.n"""


_BREAKDOWN_YEAR = f"""
SELECT o_orderpriority AS Series, lpad(twelve.n::VARCHAR, 2, '0') AS Month,
       -coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (month(o_orderdate) = twelve.n), 0)::DOUBLE
         + 0.0 AS Value
FROM {_TWELVE}, orders, customer
WHERE c_custkey = o_custkey AND o_orderstatus = 'F' AND year(o_orderdate) = {SHORT_YEAR}
GROUP BY ALL"""
_HISTORY_CONDENSED = f"""
WITH used AS (
  SELECT c_mktsegment AS account, month(o_orderdate) AS n, o_orderpriority AS category,
         CASE o_orderstatus WHEN 'F' THEN -o_totalprice WHEN 'O' THEN o_totalprice END
           ::DECIMAL(18,2) AS flow,
         o_orderstatus AS status, c_acctbal::DECIMAL(18,2) AS balance,
         row_number() OVER (PARTITION BY c_mktsegment, month(o_orderdate), o_orderpriority
                            ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS back
  FROM orders, customer WHERE c_custkey = o_custkey AND year(o_orderdate) = {SHORT_YEAR}),
filled AS (
  SELECT account, twelve.n AS n,
         coalesce(sum(balance) FILTER (back = 1 AND used.n = twelve.n AND category = '{CATEGORY}'), 0)
           AS closing,
         coalesce(sum(flow) FILTER (status = 'F' AND used.n = twelve.n AND category = '{CATEGORY}'), 0)
           AS spent,
         coalesce(sum(flow) FILTER (status = 'O' AND used.n = twelve.n AND category = '{CATEGORY}'), 0)
           AS earned
  FROM used, {_TWELVE} GROUP BY ALL),
listed AS (
  SELECT account AS Series, n, closing AS v FROM filled UNION ALL
  SELECT unnest(['Net Worth', 'Expenses', 'Income', 'Monthly Savings']), n,
         unnest([sum(closing), sum(spent), sum(earned), sum(spent + earned)])
  FROM filled GROUP BY n)
SELECT Series, lpad(n::VARCHAR, 2, '0') AS Month, v::DOUBLE AS Value FROM listed"""
_JSON = (
    """concat('{"Month":"', split_part("Date", '/', 1), '","Day":"', split_part("Date", '/', 2),"""
    """ '","Year":"', split_part("Date", '/', 3), '","Account":"', Account, '","Title":"', Title,"""
    """ '","MainCategory":"', MainCategory, '","Amount":', CAST(Amount AS VARCHAR),"""
    """ ',"Balance":', CAST(Balance AS VARCHAR), '}') AS json"""
)


def ledger_oracle_sql() -> dict[str, str]:
    expense = _flow(EXPENSE)
    return {
        "ledger_union_all": _sql(f"SELECT {_ROWS} FROM ledger"),
        "ledger_sql_scan": _where(_OF_CATEGORY, _IN_YEAR),
        "date_parts": _sql(
            f'SELECT DISTINCT "Date", {_Y} AS Year, {_M} AS Month,'
            """ split_part("Date", '/', 2) AS Day,"""
            """ CAST(split_part("Date", '/', 1) AS INTEGER) - 1 AS MonthIndex FROM ledger"""
        ),
        "month_dim": _sql(
            "SELECT CASE code WHEN '00' THEN 'All' ELSE"
            " upper(strftime(make_date(2000, CAST(code AS INTEGER), 1), '%b')) END AS label, code"
            f" FROM (SELECT DISTINCT {_M} AS code FROM ledger UNION ALL SELECT '00') AS codes"
        ),
        "round_sig1": _sql(
            "SELECT Title, CASE WHEN e >= 0 THEN round(x / pow(10, e)) * pow(10, e)"
            " ELSE round(x * pow(10, -e)) / pow(10, -e) END AS Sig1 FROM scaled",
            " scaled AS (SELECT Title, CAST(Amount AS DOUBLE) AS x,"
            " floor(log10(abs(CAST(Amount AS DOUBLE)))) AS e FROM ledger WHERE Amount <> 0)",
        ),
        "tx_year": _where(_IN_YEAR),
        "tx_year_month": _where(_IN_YEAR, _IN_MONTH),
        "tx_account": _where(_IN_YEAR, _OF_ACCOUNT),
        "tx_account_month": _where(_IN_YEAR, _OF_ACCOUNT, _IN_MONTH),
        "tx_account_category": _where(_IN_YEAR, _OF_ACCOUNT, _OF_CATEGORY),
        "tx_account_category_month": _where(_IN_YEAR, _OF_ACCOUNT, _OF_CATEGORY, _IN_MONTH),
        "tx_flow_year": _where(_IN_YEAR, expense),
        "tx_flow_year_month": _where(_IN_YEAR, expense, _IN_MONTH),
        "tx_flow_account": _where(_IN_YEAR, expense, _OF_ACCOUNT),
        "tx_flow_account_month": _where(_IN_YEAR, expense, _OF_ACCOUNT, _IN_MONTH),
        "tx_flow_account_category": _where(_IN_YEAR, expense, _OF_ACCOUNT, _OF_CATEGORY),
        "tx_flow_account_category_month": _where(
            _IN_YEAR, expense, _OF_ACCOUNT, _OF_CATEGORY, _IN_MONTH
        ),
        "tx_by_category": _where(_OF_CATEGORY),
        "dim_accounts": _dim_sql("Account"),
        "dim_categories": _dim_sql("MainCategory"),
        "dim_account_categories": _dim_sql("MainCategory", _OF_ACCOUNT),
        "dim_years": _sql(f"SELECT DISTINCT {_Y} AS value FROM ledger"),
        "expense_by_category": _share_sql(EXPENSE),
        "income_by_category": _share_sql(INCOME),
        "category_bar_expense": _bar_sql(EXPENSE),
        "category_bar_income": _bar_sql(INCOME),
        "month_end_balance": _month_end_sql(_IN_SHORT, _OF_ACCOUNT),
        "flow_month_end_balance": _month_end_sql(_IN_SHORT, _OF_ACCOUNT, expense),
        "account_month_balance": _sql(
            "SELECT Account, Month, CAST(b AS DOUBLE) AS EndBalance FROM grid", _ACCOUNT_MONTHS
        ),
        "account_month_flows": _sql(
            "SELECT Account, Month, CAST(c AS DOUBLE) AS Credit, CAST(d AS DOUBLE) AS Debit"
            " FROM grid",
            _ACCOUNT_MONTHS,
        ),
        "net_worth_monthly": _sql(
            "SELECT Month, CAST(sum(b) AS DOUBLE) AS NetWorth, CAST(sum(c) AS DOUBLE) AS Expenses,"
            " CAST(sum(d) AS DOUBLE) AS Income, CAST(sum(c) + sum(d) AS DOUBLE) AS MonthlySavings"
            " FROM grid GROUP BY Month",
            _ACCOUNT_MONTHS,
        ),
        "category_month_expense": _category_month_sql(EXPENSE),
        "category_month_income": _category_month_sql(INCOME),
        "category_year_month_pivot": _sql(
            "SELECT Year, "
            + ", ".join(f"CAST(m{code} AS DOUBLE) AS m{code}" for code in MONTH_CODES)
            + " FROM pivoted",
            _PIVOT,
        ),
        "category_monthly_mean": _sql(f"SELECT {_MEANS} FROM pivoted", _PIVOT),
        "category_year_totals": _sql(
            "SELECT Year AS Label, abs(round(CAST(s AS DOUBLE), 2)) AS Total FROM sums"
            " UNION ALL SELECT 'Mean of All Years',"
            " abs(round(sum(CAST(s AS DOUBLE)) / count(*), 2)) FROM sums",
            _YEAR_SUMS,
        ),
        "report_history": _sql(
            "SELECT Series, Month, CAST(v AS DOUBLE) AS Value FROM series", _HISTORY
        ),
        "report_history_account": _closing_sql(
            f"c_mktsegment = '{ACCOUNT}' AND o_orderpriority = '{CATEGORY}'"
        ),
        "report_history_condensed": _HISTORY_CONDENSED,
        "report_selection": _sql(_SELECTION, _HISTORY, _FLOW_MONTHS),
        "report_breakdown_year": _BREAKDOWN_YEAR,
        "report_breakdown_account": _closing_sql(
            f"c_mktsegment = '{ACCOUNT}' AND o_orderstatus = 'F'"
        ),
        "report_category_seasonality": _sql(
            "SELECT Year AS Series, Month, round(CAST(s AS DOUBLE), 2) AS Value FROM grid"
            " UNION ALL SELECT 'Monthly Avg', Month,"
            " round(sum(CAST(s AS DOUBLE)) / count(*), 2) FROM grid GROUP BY Month",
            _SEASONS,
        ),
        "view_transactions": _sql(
            f"SELECT {_VIEW} FROM ledger WHERE {_IN_YEAR} AND {_OF_ACCOUNT}"
        ),
        "view_expenses": _sql(
            f"SELECT {_VIEW} FROM ledger WHERE {_IN_YEAR} AND {_OF_ACCOUNT} AND {expense}"
        ),
        "view_income": _sql(
            f"SELECT {_VIEW} FROM ledger WHERE {_IN_YEAR} AND {_OF_ACCOUNT} AND {_flow(INCOME)}"
        ),
        "view_category": _sql(
            f"SELECT {_PARTS}, CAST(Amount AS DOUBLE) AS Amount FROM ledger WHERE {_OF_CATEGORY}"
        ),
        "view_transactions_raw": _sql(
            'SELECT "Date", Account, Title, MainCategory, CAST(Amount AS VARCHAR) AS Amount,'
            f" CAST(Balance AS VARCHAR) AS Balance FROM ledger WHERE {_IN_YEAR} AND {_OF_ACCOUNT}"
        ),
        "view_sorted_top": _sql(
            f"SELECT {_VIEW} FROM ledger WHERE {_IN_YEAR} AND {_OF_ACCOUNT}"
            " ORDER BY ledger.Amount DESC, Title LIMIT 10"
        ),
        "records_json": _sql(
            f"SELECT {_JSON} FROM ledger WHERE {_IN_YEAR} AND {_OF_ACCOUNT} AND {_IN_MONTH}"
        ),
    }
