"""Operators and reports on the golden ledger."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import golden
from tallybook.operators import balances, dimensions, totals, views
from tallybook.operators.selection import select_category, select_transactions
from tallybook.plans import reports
from tallybook.plans.ingest import ingest
from tallybook.schema import EXPENSE, INCOME, MONTH_CODES
from tallybook.sources.exports import read_exports, typed_ledger, with_period


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return golden.write(
        tmp_path_factory.mktemp("golden") / "csv",
        checking=golden.CHECKING,
        savings=golden.SAVINGS,
    )


@pytest.fixture(scope="module", params=["exports", "table"])
def ledger(request, spark, folder, tmp_path_factory):
    """The same answers must come from the exports and from the stored table."""
    if request.param == "exports":
        return typed_ledger(read_exports(spark, folder))
    return ingest(spark, folder, str(tmp_path_factory.mktemp("golden") / "table"))


def values(frame):
    return [r[0] for r in frame.collect()]


def series(frame, *keys):
    """Rows of a monthly frame as {key: {month: value}}, zeros left out, twelve months each."""
    months, answer = {}, {}
    value = [c for c in frame.columns if c not in (*keys, "Month")][0]
    for row in frame.collect():
        key = tuple(row[k] for k in keys)
        months.setdefault(key, []).append(row.Month)
        cells = answer.setdefault(key, {})
        if row[value]:
            cells[row.Month] = float(row[value])
    assert all(sorted(m) == list(MONTH_CODES) for m in months.values())
    answer = {k[0] if len(k) == 1 else k: v for k, v in answer.items()}
    return answer if keys else answer.get((), None)


def test_dimension_lists(ledger):
    assert values(dimensions.accounts(ledger)) == ["All", "Checking", "Savings"]
    assert values(dimensions.categories(ledger)) == [
        "All", "Fees", "Food", "Interest", "Salary", "Transfer",
    ]
    assert values(dimensions.account_categories(ledger, "Checking")) == [
        "All", "Food", "Salary", "Transfer",
    ]
    assert values(dimensions.account_categories(ledger)) == ["All"]
    assert values(dimensions.years(ledger)) == ["2017", "2018"]


def test_month_options(ledger):
    options = {r.code: r.label for r in dimensions.month_options(ledger).collect()}
    assert len(options) == 13
    assert (options["00"], options["01"], options["12"]) == ("All", "JAN", "DEC")
    in_use = {r.code: r.label for r in dimensions.months_in_use(ledger).collect()}
    assert in_use == {"00": "All", "01": "JAN", "02": "FEB", "03": "MAR"}


@pytest.mark.parametrize(
    "selectors, rows",
    [
        (dict(category="Food", year="2018"), 7),  # the category needs an account
        (dict(year="2018", month="02"), 3),
        (dict(account="Checking", year="2018"), 4),
        (dict(account="Checking", category="Food", year="2018"), 2),
        (dict(account="Checking", year="2018", month="02"), 2),
        (dict(account="Checking", category="Food", year="2018", month="02"), 1),
        (dict(account="Checking", category="Food", year="2018", flow="Credit"), 1),
        (dict(year="2018", flow="Credit"), 2),
        (dict(year="2018", flow="credit"), 0),
        (dict(year="2018", flow="Debit", month="02"), 1),
        (dict(account="Kid's", year="2018"), 0),
        (dict(), 0),  # the current year
    ],
)
def test_selection(ledger, selectors, rows):
    assert select_transactions(ledger, **selectors).count() == rows


def test_default_year_is_the_current_one(spark, ledger):
    year = spark.range(1).select(F.year(F.current_date()).cast("string")).first()[0]
    fresh = ledger.withColumn("Year", F.lit(year))
    assert select_transactions(fresh).count() == 10


def test_select_category(ledger):
    assert select_category(ledger).count() == 4
    assert select_category(ledger, "Fees").count() == 1


def test_category_share_nets_refunds(ledger):
    share = reports.flow_share(ledger, EXPENSE, year="2018")
    assert dict(share.collect()) == {"Fees": 2.0, "Food": 80.0}
    both = select_transactions(ledger, account="Checking", category="Food", year="2018")
    assert dict(totals.category_share(both).collect()) == {"Food": Decimal("60.00")}


def test_category_bars_are_sorted(ledger):
    selection = select_transactions(ledger, year="2018", flow=INCOME)
    bars = totals.category_bars(selection).collect()
    assert [(r.CategoryName, float(r.CategorySum)) for r in bars] == [
        ("Interest", 1.5), ("Food", 20.0), ("Salary", 1100.0),
    ]


def test_category_bars_order_ties_by_name(spark, ledger):
    twice = ledger.unionByName(ledger.withColumn("MainCategory", F.lit("Zoo")))
    twice = twice.unionByName(ledger.withColumn("MainCategory", F.lit("Art")))
    bars = totals.category_bars(twice).collect()
    names = [r.CategoryName for r in bars]
    assert names.index("Art") < names.index("Zoo")
    sums = [r.CategorySum for r in bars]
    assert sums == sorted(sums)


CHECKING = {"01": 1769.75, "02": 1289.75}


def test_month_end_follows_the_lines_of_the_file(ledger):
    selection = select_transactions(ledger, year="2018")
    assert series(balances.account_month_balance(selection), "Account") == {
        "Checking": CHECKING,
        "Savings": {"02": 500.0, "03": 499.5},
    }


def test_month_end_by_date(ledger):
    selection = select_transactions(ledger, year="2018")
    assert series(balances.account_month_balance(selection, "date"), "Account") == {
        "Checking": CHECKING,
        "Savings": {"02": 500.0, "03": 501.5},
    }


def test_month_end_of_one_selection(ledger):
    selection = select_transactions(ledger, account="Checking", year="2018")
    assert series(balances.month_end_balance(selection)) == CHECKING
    flow = select_transactions(ledger, account="Checking", year="2018", flow=EXPENSE)
    assert series(balances.month_end_balance(flow)) == {"01": 1769.75}


def test_bad_order_is_refused(ledger):
    for order in ("newest", []):
        with pytest.raises(ValueError):
            balances.month_end_balance(ledger, order)


def test_account_month_flows(ledger):
    flows = balances.account_month_flows(select_transactions(ledger, year="2018"))
    rows = {(r.Account, r.Month): (float(r.Credit), float(r.Debit)) for r in flows.collect()}
    assert len(rows) == 24
    assert {k: v for k, v in rows.items() if any(v)} == {
        ("Checking", "01"): (-80.0, 1100.0),
        ("Checking", "02"): (0.0, 20.0),
        ("Savings", "03"): (-2.0, 1.5),
    }


def test_net_worth(ledger):
    worth = balances.net_worth_monthly(select_transactions(ledger, year="2018"))
    rows = {r.Month: [float(x) for x in r[1:]] for r in worth.collect()}
    assert len(rows) == 12
    assert {m: v for m, v in rows.items() if any(v)} == {
        "01": [1769.75, -80.0, 1100.0, 1020.0],
        "02": [1789.75, 0.0, 20.0, 20.0],
        "03": [499.5, -2.0, 1.5, -0.5],
    }


def test_history_of_all_accounts(ledger):
    assert series(reports.history(ledger, year="2018"), "Series") == {
        "Checking": CHECKING,
        "Savings": {"02": 500.0, "03": 499.5},
        "Net Worth": {"01": 1769.75, "02": 1789.75, "03": 499.5},
        "Expenses": {"01": -80.0, "03": -2.0},
        "Income": {"01": 1100.0, "02": 20.0, "03": 1.5},
        "Monthly Savings": {"01": 1020.0, "02": 20.0, "03": -0.5},
    }


def test_history_keeps_accounts_without_the_category(ledger):
    history = series(reports.history(ledger, category="Food", year="2018"), "Series")
    assert history["Checking"] == {"01": 1769.75, "02": 1289.75}
    assert history["Savings"] == {}
    assert history["Expenses"] == {"01": -80.0}
    assert history["Income"] == {"02": 20.0}


def test_history_of_one_account_and_month(ledger):
    one = reports.history(ledger, "Checking", year="2018", month="02")
    assert series(one, "Series") == {"End Of Month Balance": {"02": 1289.75}}


def test_account_called_like_a_total_stays_apart(ledger):
    renamed = ledger.withColumn(
        "Account", F.when(F.col("Account") == "Savings", "Net Worth").otherwise(F.col("Account"))
    )
    rows = reports.history(renamed, year="2018").where("Series = 'Net Worth'").collect()
    assert len(rows) == 24


def test_flow_breakdown(ledger):
    whole_year = reports.flow_breakdown(ledger, EXPENSE, year="2018")
    assert series(whole_year, "Series") == {"Fees": {"03": -2.0}, "Food": {"01": -80.0}}
    one_account = reports.flow_breakdown(ledger, EXPENSE, "Checking", year="2018")
    assert series(one_account, "Series") == {"End Of Month Balance": {"01": 1769.75}}
    one_month = reports.flow_breakdown(ledger, INCOME, year="2018", month="03")
    assert [tuple(r) for r in one_month.collect()] == [("Interest", 1.5)]


def test_year_month_pivot(ledger):
    pivot = totals.year_month_pivot(select_category(ledger))
    assert pivot.columns == ["Year"] + [f"m{c}" for c in MONTH_CODES]
    rows = {r.Year: [float(x) for x in r[1:]] for r in pivot.collect()}
    assert rows == {
        "2017": [-200.0, 0, -50.25] + [0] * 9,
        "2018": [-80.0, 20.0] + [0] * 10,
    }


def test_monthly_mean_counts_empty_months(ledger):
    mean = totals.monthly_mean(select_category(ledger)).collect()
    assert [list(r) for r in mean] == [[-140.0, 10.0, -25.125] + [0.0] * 9]


def test_category_seasonality(ledger):
    assert series(reports.category_seasonality(ledger), "Series") == {
        "2017": {"01": -200.0, "03": -50.25},
        "2018": {"01": -80.0, "02": 20.0},
        "Monthly Avg": {"01": -140.0, "02": 10.0, "03": -25.125},
    }


def test_category_years(ledger):
    assert dict(reports.category_years(ledger).collect()) == {
        "2017": 250.25, "2018": 60.0, "Mean of All Years": 155.13,
    }


def test_views(ledger):
    view = views.transactions(ledger, "Savings", year="2018")
    assert view.columns == [
        "Month", "Day", "Year", "Account", "Title", "MainCategory", "Amount", "Balance",
    ]
    top = views.arrange(view, where="Amount > 0", order_by=[F.desc("Amount")], limit=1)
    assert [tuple(r) for r in top.collect()] == [
        ("02", "10", "2018", "Savings", "From checking", "Transfer",
         Decimal("500.00"), Decimal("500.00")),
    ]
    assert views.expenses(ledger, year="2018").count() == 2
    assert views.income(ledger, year="2018").count() == 3
    food = views.category_rows(ledger)
    assert food.columns == view.columns[:-1] and food.count() == 4
    assert views.arrange(view).count() == 3


def test_text_view_shows_the_export(spark, tmp_path):
    folder = golden.write(
        tmp_path / "csv", one=golden.SAVINGS.replace("500.00,500.00", "5e2,0500.0")
    )
    raw = with_period(read_exports(spark, folder))
    view = views.transactions_as_text(raw, "Savings", year="2018", month="02")
    assert [tuple(r) for r in view.collect()] == [
        ("02/10/2018", "Savings", "From checking", "Transfer", "5e2", "0500.0"),
    ]


def test_records_keep_missing_cells(ledger):
    view = ledger.where("Title = 'Fee'").select(
        "Title", "Comment", F.lit(None).cast("decimal(18,2)").alias("Amount"), "Balance"
    )
    assert values(views.records(view)) == [
        '{"Title":"Fee","Comment":"","Amount":null,"Balance":499.50}'
    ]


def test_empty_selection_gives_no_rows(ledger):
    year = "1900"
    selection = select_transactions(ledger, year=year)
    empty = [
        balances.month_end_balance(selection),
        balances.account_month_balance(selection),
        balances.account_month_flows(selection),
        balances.net_worth_monthly(selection),
        totals.category_share(selection),
        totals.category_bars(selection),
        totals.category_month_sums(selection),
        totals.monthly_mean(selection),
        totals.seasonality(selection),
        totals.year_comparison(selection),
        reports.history(ledger, year=year),
        reports.history(ledger, "Checking", year=year),
        reports.flow_share(ledger, EXPENSE, year=year),
        reports.flow_breakdown(ledger, EXPENSE, year=year),
        reports.category_seasonality(ledger, "Nothing"),
        reports.category_years(ledger, "Nothing"),
        views.records(views.transactions(ledger, year=year)),
    ]
    for frame in empty:
        assert frame.collect() == []
