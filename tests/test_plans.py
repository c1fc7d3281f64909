"""Plans: what is read, what is shuffled, and what must not appear."""

import re
from decimal import Decimal

import pytest

import __spark_entry__ as contract
import golden
from driver_tables import TESTDATA
from tallybook.operators import balances, dimensions, views
from tallybook.operators.selection import select_category, select_transactions
from tallybook.plans import reports
from tallybook.plans.derived import refresh_dictionary, table_years
from tallybook.plans.ingest import ingest
from tallybook.sources.exports import read_exports, typed_ledger

QUERIES = contract.ledger_queries()
SF = f"{TESTDATA}/sf0.01"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def whole_strings(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_leaves_the_jvm_or_pairs_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in (
        "EvalPython", "InPandas", "Window", "CartesianProduct", "NestedLoopJoin", "SortAggregate",
        "SinglePartition",
    ):
        assert operator not in text, operator
    scans = len(re.findall(r"FileScan parquet .*orders\.parquet", text))
    assert scans == (4 if name == "ledger_union_all" else 1)


def test_year_reaches_the_scan_of_the_orders(spark):
    text = plan(QUERIES["net_worth_monthly"](spark, SF))
    scan = next(line for line in text.splitlines() if "orders.parquet" in line)
    assert "GreaterThanOrEqual(o_orderdate,2001-01-01T00:00)" in scan
    assert "LessThan(o_orderdate,2002-01-01T00:00)" in scan
    assert "o_orderpriority" not in scan


def pushed(spark, name):
    scans = [line for line in plan(QUERIES[name](spark, SF)).splitlines() if "orders.parquet" in line]
    return [re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan).group(1) for scan in scans]


MONTH_QUERIES = [
    "tx_year_month", "tx_account_month", "tx_account_category_month", "tx_flow_year_month",
    "tx_flow_account_month", "tx_flow_account_category_month", "category_bar_expense",
    "category_bar_income", "records_json",
]


@pytest.mark.parametrize("name", MONTH_QUERIES)
def test_month_reaches_the_scan(spark, name):
    (filters,) = pushed(spark, name)
    assert "GreaterThanOrEqual(o_orderdate,1998-03-01T00:00)" in filters
    assert "LessThan(o_orderdate,1998-04-01T00:00)" in filters


def test_year_of_the_query_text_reaches_the_scan(spark):
    (filters,) = pushed(spark, "ledger_sql_scan")
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in filters
    assert "LessThan(o_orderdate,1999-01-01T00:00)" in filters


def test_parts_of_the_union_read_disjoint_days(spark):
    first, second, third, unknown = pushed(spark, "ledger_union_all")
    assert "LessThan(o_orderdate,1997-01-01T00:00)" in first
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in second
    assert "LessThan(o_orderdate,1999-01-01T00:00)" in second
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01T00:00)" in third
    assert "IsNull(o_orderdate)" in unknown


def test_selectors_reach_the_scans(spark):
    text = plan(QUERIES["tx_account_category"](spark, SF))
    assert "EqualTo(o_orderpriority,5-LOW)" in text
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    text = plan(QUERIES["expense_by_category"](spark, SF))
    customers = next(line for line in text.splitlines() if "customer.parquet" in line)
    assert "ReadSchema: struct<c_custkey:bigint>" in customers


def test_sorted_top_does_not_sort_everything(spark):
    text = plan(QUERIES["view_sorted_top"](spark, SF))
    assert "TakeOrderedAndProject(limit=10" in text and "Exchange range" not in text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    folder = golden.write(root / "csv", checking=golden.CHECKING, savings=golden.SAVINGS)
    return ingest(spark, folder, str(root / "table"))


def test_year_prunes_directories(stored):
    text = plan(reports.history(stored, "Checking", year="2018"))
    filters = re.search(r"PartitionFilters: \[(.*?)\], Pushed", text).group(1)
    assert "Year" in filters and "2018" in filters
    assert "EqualTo(Account,Checking)" in text
    assert "Title" not in re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    # the default year is a constant by then, too
    text = plan(select_transactions(stored))
    assert "Year" in re.search(r"PartitionFilters: \[(.*?)\], Pushed", text).group(1)


def test_category_search_pushes_the_category(stored):
    text = plan(reports.category_years(stored))
    assert "EqualTo(MainCategory,Food)" in text


@pytest.mark.parametrize(
    "report, exchanges",
    [
        (lambda t: balances.account_month_balance(select_transactions(t, year="2018")), 2),
        (lambda t: balances.net_worth_monthly(select_transactions(t, year="2018")), 3),
        (lambda t: reports.history(t, year="2018"), 3),
    ],
)
def test_closing_on_the_stored_table_is_hashed_and_exchanged_once(stored, report, exchanges):
    text = plan(report(stored))
    # the step next to the scan is the one that sees every row
    first = [line for line in text.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in first and "partial_max_by" in first
    for operator in ("Window", "SortAggregate", "Sort ["):
        assert operator not in text
    # closing balances, and the twelve months of them
    assert len(re.findall(r"\bExchange\b", text)) == exchanges


def test_files_of_sub_folders_are_not_listed(spark, tmp_path):
    folder = golden.write(tmp_path / "csv", checking=golden.CHECKING)
    golden.write(tmp_path / "csv" / "old", deep="a,b\n1,2\n" * 1000)
    ledger = select_category(typed_ledger(read_exports(spark, folder)))
    assert ledger.count() == 4


def test_all_reports_of_a_selection_read_and_exchange_the_postings_once(spark, stored):
    text = plan(reports.selection_reports(stored, year="2018"))
    assert text.count("FileScan parquet") == 1 and text.count("Expand") == 1
    # The exchange of the postings' groups, and the two of the twelve months.
    assert len(re.findall(r"\bExchange\b", text)) == 3
    for operator in ("Window", "SortAggregate", "Sort ["):
        assert operator not in text


def test_pages_are_the_top_rows_behind_the_last_page(stored):
    view = views.transactions(stored, "Checking", year="2018", positions=True)
    for after in (None, (Decimal("20.00"), 5)):
        text = plan(views.page(view, ["-Amount"], 3, after))
        assert "TakeOrderedAndProject(limit=3" in text and "Exchange range" not in text
    assert "Amount" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)


def test_lists_do_not_read_the_ledger(spark, stored, tmp_path_factory):
    root = tmp_path_factory.mktemp("lists")
    path = stored.inputFiles()[0].split("/Year=")[0]
    listed = refresh_dictionary(spark, path, str(root / "dictionary"))
    for frame in (dimensions.accounts(listed), dimensions.account_categories(listed, "Checking")):
        scans = re.findall(r"FileScan.*", plan(frame))
        assert scans and all("/dictionary" in scan for scan in scans)
    assert "FileScan" not in plan(table_years(spark, path))
