"""Reports on random exports against plain Python over the same lines.

The exports hold what real ones do: blank amounts, balances and categories, quotes in names,
an account called like a sentinel or a total, dates out of order and without padding.
"""

import csv
import itertools
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql.types import DecimalType

from tallybook.functions.money import money_as_double
from tallybook.operators import balances, dimensions, totals
from tallybook.operators.condense import condense
from tallybook.operators.selection import select_category, select_transactions
from tallybook.plans import reports
from tallybook.schema import EXPENSE, INCOME, LEDGER_COLUMNS, MONTH_CODES
from tallybook.sources.exports import read_exports, typed_ledger
from tallybook.sources.tables import read_table, write_table

ACCOUNTS = ["Checking", "Kid's", "001", "Net Worth"]
CATEGORIES = ["Food", "", 'Say "x", y', "Rent"]
FLOWS = ["Credit", "Debit", "Transfer", "credit"]


def random_rows(source, count):
    for number in range(count):
        month, day, year = source.randint(1, 12), source.randint(1, 28), source.randint(2016, 2018)
        date = f"{month:02d}/{day:02d}/{year}"
        if source.random() < 0.1:
            date = f"{month}/{day}/{year}"
        yield (
            date,
            f"t{number}",
            source.choice(["", "note"]),
            source.choice(CATEGORIES),
            source.choice(FLOWS),
            source.choice(ACCOUNTS),
            "" if source.random() < 0.1 else f"{source.randint(-90000, 90000) / 100:.2f}",
            "" if source.random() < 0.1 else f"{source.randint(-90000, 90000) / 100:.2f}",
        )


@pytest.fixture(scope="module", params=["lines", "other lines", "condensed"])
def books(request, spark, tmp_path_factory):
    """The rows in file order, and the ledger Spark reads from the files."""
    source = random.Random(request.param)
    folder = tmp_path_factory.mktemp("brute") / "csv"
    folder.mkdir()
    rows = []
    for name in ("a.csv", "b.csv", "c.csv"):
        part = list(random_rows(source, 250))
        with open(folder / name, "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(LEDGER_COLUMNS)
            writer.writerows(part)
        rows += [dict(zip(LEDGER_COLUMNS, cells)) for cells in part]
    ledger = typed_ledger(read_exports(spark, str(folder)))
    if request.param == "condensed":
        table = str(folder.parent / "table")
        write_table(condense(ledger), table)
        ledger = read_table(spark, table, DecimalType(28, 2))
        assert 300 < ledger.count() < 750
    ledger = ledger.cache()
    yield rows, ledger
    ledger.unpersist()


def picked(rows, account="All", category="All", year="2018", month="00", flow=None):
    return [
        r
        for r in rows
        if r["Date"][6:10] == year
        and (month == "00" or r["Date"][:2] == month)
        and (flow is None or r["Subcategory"] == flow)
        and (account == "All" or r["Account"] == account)
        and (account == "All" or category == "All" or r["MainCategory"] == category)
    ]


def month_of(row):
    return f"{int(row['Date'].split('/')[0]):02d}"


def year_of(row):
    return row["Date"].split("/")[2]


def number(text):
    return Decimal(text) if text else Decimal(0)


def dense(cells, keys):
    return sorted((*key, m, float(cells.get((*key, m), 0))) for key in keys for m in MONTH_CODES)


def last_balances(rows, key):
    return {(*key(r), month_of(r)): Decimal(r["Balance"]) for r in rows if r["Balance"]}


def sums(rows, key):
    answer = defaultdict(Decimal)
    for r in rows:
        answer[key(r)] += number(r["Amount"])
    return answer


def result(frame):
    return sorted(tuple(r) for r in money_as_double(frame).collect())


SELECTORS = [
    dict(),
    dict(category="Food"),
    dict(month="03"),
    dict(account="Kid's"),
    dict(account="Kid's", category=""),
    dict(account="001", month="11"),
    dict(account="Checking", category='Say "x", y', month="06"),
    dict(year="18"),
    dict(year="1999"),
]


@pytest.mark.parametrize("selectors", SELECTORS, ids=str)
def test_selection(books, selectors):
    rows, ledger = books
    for flow in (None, "Credit"):
        chosen = select_transactions(ledger, **{"year": "2018", **selectors}, flow=flow)
        expected = picked(rows, **selectors, flow=flow)
        titles = sorted(r.Title for r in chosen.select("Title").collect())
        if "" not in titles:  # a condensed ledger has no titles
            assert titles == sorted(r["Title"] for r in expected)
        wanted = sums(expected, lambda r: r["Account"])
        summed = chosen.groupBy("Account").agg({"Amount": "sum"}).na.fill(0)
        assert result(summed) == sorted((a, float(v)) for a, v in wanted.items())


@pytest.mark.parametrize("selectors", SELECTORS, ids=str)
def test_history(books, selectors):
    rows, ledger = books
    chosen = picked(rows, **selectors)
    if selectors.get("account", "All") != "All":
        cells = last_balances(chosen, lambda r: ("End Of Month Balance",))
        wanted = dense(cells, [("End Of Month Balance",)] if chosen else [])
    else:
        category = selectors.get("category", "All")
        kept = [r for r in chosen if category in ("All", r["MainCategory"])]
        closing = last_balances(kept, lambda r: (r["Account"],))
        accounts = {(r["Account"],) for r in chosen}
        wanted = dense(closing, accounts)
        total = defaultdict(Decimal)
        for (_, month), balance in closing.items():
            total["Net Worth", month] += balance
        for flow, name in ((EXPENSE, "Expenses"), (INCOME, "Income")):
            of_flow = [r for r in kept if r["Subcategory"] == flow]
            for month, amount in sums(of_flow, month_of).items():
                total[name, month] += amount
                total["Monthly Savings", month] += amount
        names = ("Net Worth", "Expenses", "Income", "Monthly Savings")
        wanted += dense(total, [(n,) for n in names] if chosen else [])
    frame = reports.history(ledger, **{"year": "2018", **selectors})
    assert result(frame) == sorted(wanted)


@pytest.mark.parametrize("flow", [EXPENSE, INCOME])
@pytest.mark.parametrize("selectors", SELECTORS, ids=str)
def test_share_and_breakdown(books, selectors, flow):
    rows, ledger = books
    parameters = {"year": "2018", **selectors}
    chosen = picked(rows, **selectors, flow=flow)
    sizes = {k: abs(v) for k, v in sums(chosen, lambda r: r["MainCategory"]).items()}
    share = sorted((k, float(v)) for k, v in sizes.items())
    assert result(reports.flow_share(ledger, flow, **parameters)) == share

    breakdown = reports.flow_breakdown(ledger, flow, **parameters)
    if selectors.get("month", "00") != "00":
        bars = sorted(share, key=lambda bar: (bar[1], bar[0]))
        assert [tuple(r) for r in breakdown.collect()] == bars
    elif selectors.get("account", "All") == "All":
        cells = sums(chosen, lambda r: (r["MainCategory"], month_of(r)))
        assert result(breakdown) == dense(cells, {(r["MainCategory"],) for r in chosen})
    else:
        cells = last_balances(chosen, lambda r: ("End Of Month Balance",))
        assert result(breakdown) == dense(
            cells, [("End Of Month Balance",)] if chosen else []
        )


def test_flows_and_net_worth(books):
    rows, ledger = books
    chosen, selection = picked(rows), select_transactions(ledger, year="2018")
    credit = sums([r for r in chosen if r["Subcategory"] == EXPENSE],
                  lambda r: (r["Account"], month_of(r)))
    debit = sums([r for r in chosen if r["Subcategory"] == INCOME],
                 lambda r: (r["Account"], month_of(r)))
    accounts = sorted({r["Account"] for r in chosen})
    assert result(balances.account_month_flows(selection)) == sorted(
        (a, m, float(credit[a, m]), float(debit[a, m]))
        for a, m in itertools.product(accounts, MONTH_CODES)
    )
    closing = last_balances(chosen, lambda r: (r["Account"],))
    wanted = []
    for month in MONTH_CODES:
        worth, out, into = (
            sum((cells.get((a, month), Decimal(0)) for a in accounts), Decimal(0))
            for cells in (closing, credit, debit)
        )
        wanted.append((month, float(worth), float(out), float(into), float(into + out)))
    assert result(balances.net_worth_monthly(selection)) == wanted


@pytest.mark.parametrize("category", [*CATEGORIES, "Nothing"])
def test_category_search(books, category):
    rows, ledger = books
    chosen = [r for r in rows if r["MainCategory"] == category]
    years = sorted({year_of(r) for r in chosen})
    cells = sums(chosen, lambda r: (year_of(r), month_of(r)))
    selection = select_category(ledger, category)

    pivot = [(y, *(float(cells.get((y, m), 0)) for m in MONTH_CODES)) for y in years]
    assert result(totals.year_month_pivot(selection)) == pivot

    season = reports.category_seasonality(ledger, category).collect()
    series = {(r.Series, r.Month): r.Value for r in season}
    assert len(series) == len(season) == (12 * (len(years) + 1) if years else 0)
    for year, month in itertools.product(years, MONTH_CODES):
        assert series[year, month] == float(cells.get((year, month), 0))
    for month in MONTH_CODES if years else []:
        total = sum((cells.get((y, month), Decimal(0)) for y in years), Decimal(0))
        assert series["Monthly Avg", month] == pytest.approx(float(total) / len(years))

    def cents(amount):
        return float(abs(amount.quantize(Decimal("0.01"), ROUND_HALF_UP)))

    per_year = sums(chosen, year_of)
    bars = [(y, cents(per_year[y])) for y in years]
    if years:
        bars.append(("Mean of All Years", cents(sum(per_year.values()) / len(years))))
    assert result(reports.category_years(ledger, category)) == sorted(bars)


def test_lists(books):
    rows, ledger = books

    def listed(frame):
        return [r.value for r in frame.collect()]

    assert listed(dimensions.accounts(ledger)) == sorted({r["Account"] for r in rows} | {"All"})
    assert listed(dimensions.categories(ledger)) == sorted(
        {r["MainCategory"] for r in rows} | {"All"}
    )
    assert listed(dimensions.years(ledger)) == sorted({r["Date"][6:10] for r in rows})


@pytest.mark.parametrize("account", ["All", "Checking", "nobody"])
@pytest.mark.parametrize("category", ["All", "Food"])
@pytest.mark.parametrize("month", ["00", "03"])
def test_all_reports_of_a_selection_at_once(books, account, category, month):
    """One table of all reports has what the reports have one by one."""
    _, ledger = books
    choice = dict(account=account, category=category, year="2018", month=month)
    expected = [("History", *r) for r in reports.history(ledger, **choice).collect()]
    for flow, name in ((EXPENSE, "Expense"), (INCOME, "Income")):
        share = reports.flow_share(ledger, flow, **choice).collect()
        expected += [(f"{name} Share", r.MainCategory, month, r.CategorySum) for r in share]
        detail = reports.flow_breakdown(ledger, flow, **choice)
        if month == "00":
            expected += [(f"{name} Breakdown", *r) for r in detail.collect()]
        else:
            expected += [
                (f"{name} Breakdown", r.CategoryName, month, r.CategorySum) for r in detail.collect()
            ]
    found = reports.selection_reports(ledger, **choice).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    if account == "nobody":
        assert not found
