"""New files only, each written once, in the order of one ingest."""

from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import golden
from tallybook.functions.positions import of_batch
from tallybook.operators import balances
from tallybook.plans.incremental import ingest_new, write_batch
from tallybook.plans.ingest import ingest
from tallybook.schema import LEDGER_COLUMNS, POSITION
from tallybook.sources.files import Listing, plain_files
from tallybook.sources.tables import read_table
from test_sources import HEADER, row


def lines(ledger):
    return [tuple(r) for r in ledger.orderBy(POSITION).select(*LEDGER_COLUMNS).collect()]


def export(folder, name, *titles):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + "".join(row(Title=t, Balance=f"{len(t)}.00") for t in titles))


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    folder, table, state = tmp_path / "csv", str(tmp_path / "table"), str(tmp_path / "state")
    export(folder, "b.csv", "b1", "b2")
    export(folder, "a.csv", "a1")
    (folder / "sub").mkdir()
    export(folder / "sub", "z.csv", "hidden")
    assert [r[1] for r in lines(ingest_new(spark, str(folder), table, state))] == ["a1", "b1", "b2"]
    before = {p.name for p in (tmp_path / "table").rglob("*.parquet")}
    export(folder, "c.csv", "c1", "c22")
    # were an old file read again, it would be seen in its new form
    (folder / "a.csv").write_text("not,even\nan export")
    ledger = ingest_new(spark, str(folder), table, state)
    assert [r[1] for r in lines(ledger)] == ["a1", "b1", "b2", "c1", "c22"]
    assert before < {p.name for p in (tmp_path / "table").rglob("*.parquet")}
    after = sorted(p.name for p in (tmp_path / "table").rglob("*.parquet"))
    assert lines(ingest_new(spark, str(folder), table, state)) == lines(ledger)
    assert after == sorted(p.name for p in (tmp_path / "table").rglob("*.parquet"))
    january = balances.month_end_balance(ledger).where("Month = '01'").first()
    assert january.EndBalance == Decimal("3.00")


def test_order_is_that_of_one_ingest(spark, tmp_path):
    folder = tmp_path / "csv"
    for number, name in enumerate(("a", "b", "c", "d")):
        export(folder, f"{name}.csv", *[f"{name}{i}" for i in range(50)])
        if number % 2:
            ledger = ingest_new(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "state"))
    assert lines(ledger) == lines(ingest(spark, str(folder), str(tmp_path / "once")))


def test_batches_follow_what_the_table_has(spark, tmp_path):
    table = str(tmp_path / "table")
    first = golden.write(tmp_path / "first", checking=golden.CHECKING)
    ingest(spark, first, table)
    export(tmp_path / "csv", "a.csv", "new")
    for _ in range(2):
        ledger = ingest_new(spark, str(tmp_path / "csv"), table, str(tmp_path / "state"))
    assert [r[1] for r in lines(ledger)][-1] == "new"
    assert ledger.count() == 8


@pytest.mark.parametrize("written", [0, 1, 2])
def test_a_batch_that_runs_twice_is_written_once(spark, tmp_path, written):
    folder, table = tmp_path / "csv", str(tmp_path / "table")
    export(folder, "a.csv", "a1", "a2")
    export(folder, "b.csv", "b1")
    both = plain_files(spark, str(folder))
    write_batch(spark, both, table, 0)
    once = lines(read_table(spark, table))
    if written < 2:
        # A run that ended while its files were moved into the table: some lines are there.
        part = read_table(spark, table).where(F.col("Title") == "a1").limit(written)
        partial = str(tmp_path / "partial")
        part.write.partitionBy("Year").parquet(partial)
        if not written:
            partial = str(tmp_path / "none")
    else:
        partial = table
    write_batch(spark, both, partial, 0)
    ledger = read_table(spark, partial)
    assert lines(ledger) == once
    assert ledger.select(POSITION).distinct().count() == 3
    assert ledger.where(of_batch(0)).count() == 3
    assert ledger.where(of_batch(1)).count() == 0


def test_bad_lines_stop_the_run_and_the_next_one_takes_the_mended_file(spark, tmp_path):
    folder, table, state = tmp_path / "csv", str(tmp_path / "table"), str(tmp_path / "state")
    export(folder, "a.csv", "a1")
    ingest_new(spark, str(folder), table, state)
    (folder / "b.csv").write_text(HEADER + "too,short\n")
    with pytest.raises(StreamingQueryException, match="1 bad lines"):
        ingest_new(spark, str(folder), table, state)
    export(folder, "b.csv", "b1")
    assert [r[1] for r in lines(ingest_new(spark, str(folder), table, state))] == ["a1", "b1"]


def test_a_file_spark_would_pass_over_is_an_error(spark, tmp_path):
    export(tmp_path / "csv", "_a.csv", "a1")
    with pytest.raises(ValueError, match="_a.csv"):
        ingest_new(spark, str(tmp_path / "csv"), str(tmp_path / "table"), str(tmp_path / "state"))


def test_a_listing_is_cut_to_some_files(spark, tmp_path):
    export(tmp_path / "csv", "a.csv", "a1")
    export(tmp_path / "csv", "b.csv", "b1")
    listing = plain_files(spark, str(tmp_path / "csv"))
    assert listing.whole and len(listing.sources()) == 1
    assert listing.only([1]) == Listing(listing.files[1:])
