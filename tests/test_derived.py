"""Condensed ledger and dictionary kept up to date, and pages of a view."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tallybook.functions.positions import first_of_batch, of_batch
from tallybook.operators import dimensions, views
from tallybook.operators.condense import condense, condensed_state, merge_states
from tallybook.plans import reports
from tallybook.plans.derived import (
    read_condensed,
    refresh_condensed,
    refresh_dictionary,
    table_years,
)
from tallybook.plans.ingest import ingest
from tallybook.schema import LEDGER_COLUMNS, POSITION
from tallybook.sources.tables import read_table
from test_brute_force import random_rows


def rows(frame):
    return sorted(map(repr, frame.collect()))


def export(folder, name, source, count, years=None):
    folder.mkdir(exist_ok=True)
    lines = [
        (f"{cells[0][:-4]}{years}" if years else cells[0], *cells[1:])
        for cells in random_rows(source, count)
    ]
    with open(folder / name, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(LEDGER_COLUMNS)
        writer.writerows(lines)
    return str(folder)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A ledger of four batches; the third has lines of one year only."""
    root = tmp_path_factory.mktemp("derived")
    source, path = random.Random(5), str(root / "table")
    for number, (count, year) in enumerate(((200, None), (150, None), (40, "2017"), (100, None))):
        ingest(spark, export(root / f"csv{number}", "a.csv", source, count, year), path, "append")
    return path


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_merged_states_are_the_state_of_all(spark, table, cut):
    ledger = read_table(spark, table)
    first = first_of_batch(cut)
    old = condensed_state(ledger.where(F.col(POSITION) < first))
    new = condensed_state(ledger.where(F.col(POSITION) >= first))
    whole = condensed_state(ledger)
    assert rows(merge_states(old, new, first)) == rows(whole)
    # once more changes nothing, nor does a merge of which only some groups were written
    assert rows(merge_states(whole, new, first)) == rows(whole)
    half = whole.where("Account < 'D'").unionByName(old.where("Account >= 'D'"))
    assert rows(merge_states(half, new, first)) == rows(whole)
    nothing = condensed_state(ledger.where("false"))
    assert rows(merge_states(nothing, whole, 0)) == rows(whole)
    assert rows(merge_states(whole, nothing, 0)) == rows(whole)


def test_condensed_ledger_is_kept_up_to_date(spark, table, tmp_path):
    ledger, path = read_table(spark, table), str(tmp_path / "months")
    part = str(tmp_path / "part")
    for batches in (1, 3, 4, 4):
        # the table as it was after so many batches
        ledger.where(F.col(POSITION) < first_of_batch(batches)).write.mode("overwrite").partitionBy(
            "Year"
        ).parquet(f"{part}{batches}")
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "months").rglob("*.parquet")}
        months = refresh_condensed(spark, f"{part}{batches}", path)
        assert rows(months) == rows(condense(read_table(spark, f"{part}{batches}")))
    assert rows(reports.history(months, category="Food", year="2018")) == rows(
        reports.history(ledger, category="Food", year="2018")
    )
    assert before  # the last refresh had files to leave alone


def test_years_that_a_batch_does_not_touch_are_not_written_again(spark, table, tmp_path):
    path = str(tmp_path / "months")
    for batches in (2, 3):
        part = str(tmp_path / f"part{batches}")
        read_table(spark, table).where(F.col(POSITION) < first_of_batch(batches)).write.partitionBy(
            "Year"
        ).parquet(part)
        before = {p.name for p in (tmp_path / "months").rglob("Year=2018/*.parquet")}
        refresh_condensed(spark, part, path)
    assert read_table(spark, part).where(of_batch(2) & (F.col("Year") == "2018")).isEmpty()
    after = {p.name for p in (tmp_path / "months").rglob("Year=2018/*.parquet")}
    assert before and before == after
    assert rows(read_condensed(spark, path)) == rows(condense(read_table(spark, part)))


def test_lists_of_the_dictionary_are_those_of_the_ledger(spark, table, tmp_path):
    ledger = read_table(spark, table)
    for _ in range(2):
        listed = refresh_dictionary(spark, table, str(tmp_path / "dictionary"))
        assert listed.count() == listed.drop("_batch").distinct().count()
        for of in (
            dimensions.accounts,
            dimensions.categories,
            dimensions.years,
            dimensions.months_in_use,
            lambda frame: dimensions.account_categories(frame, "Kid's"),
        ):
            assert rows(of(listed)) == rows(of(ledger))
    assert table_years(spark, table).collect() == dimensions.years(ledger).collect()


@pytest.mark.parametrize("order_by", [["-Amount"], ["Account", "-Balance"], ["MainCategory"], []])
@pytest.mark.parametrize("size", [7, 50])
def test_pages_together_are_the_sorted_view(spark, table, order_by, size):
    view = views.transactions(read_table(spark, table), year="2017", positions=True)
    turned = [F.col(n[1:]).desc() if n[0] == "-" else F.col(n).asc() for n in order_by]
    expected = view.orderBy(*turned, POSITION).collect()
    found, end = [], None
    while page := views.page(view, order_by, size, end).collect():
        found += page
        end = views.page_end(page, order_by)
    assert found == expected and len(found) > 100
    assert views.page_end([], order_by) is None
    with pytest.raises(ValueError):
        views.page(view, order_by, size, (1,) * 9)
