"""The ledger along a curve: both columns skip files, rows and answers stay."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallybook.functions.curves import range_number, z_order
from tallybook.operators.selection import select_category, select_transactions
from tallybook.plans import reports
from tallybook.plans.clustering import cluster_by_category, range_starts
from tallybook.plans.ingest import ingest
from tallybook.schema import LEDGER_COLUMNS, POSITION
from tallybook.sources.tables import read_table, write_table

FILES = 64


def made(spark, count, account, category):
    """A ledger of one year; columns in the types of the stored table."""
    base = spark.range(0, count, 1, 8)
    return base.select(
        F.format_string("%02d/05/2018", F.col("id") % 12 + 1).alias("Date"),
        F.lit("t").alias("Title"),
        F.lit("").alias("Comment"),
        category.alias("MainCategory"),
        F.when(F.col("id") % 3 == 0, "Debit").otherwise("Credit").alias("Subcategory"),
        account.alias("Account"),
        (F.col("id") % 1000).cast("decimal(18,2)").alias("Amount"),
        F.lit(1).cast("decimal(18,2)").alias("Balance"),
        F.format_string("%02d", F.col("id") % 12 + 1).alias("Month"),
        F.lit("2018-01-05").cast("date").alias("LedgerDate"),
        F.col("id").alias(POSITION),
        F.lit("2018").alias("Year"),
    )


def name(prefix, number, of):
    """Spread over ``of`` names, not in their order."""
    return F.format_string(f"{prefix}%03d", F.pmod(F.xxhash64(number, F.lit(prefix)), F.lit(of)))


def bounds(path, column):
    """Least and greatest value of a column in each file, by the footers."""
    found = []
    for file in sorted(path.glob("Year=*/*.parquet")):
        footer = pq.ParquetFile(file).metadata
        place = footer.schema.names.index(column)
        groups = [footer.row_group(g).column(place).statistics for g in range(footer.num_row_groups)]
        found.append((min(s.min for s in groups), max(s.max for s in groups)))
    return found


def most_read(path, column, values):
    """Files that a reader of one value cannot skip: the most over the values, and all files."""
    files = bounds(path, column)
    return max(sum(low <= v <= high for low, high in files) for v in values), len(files)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("curve")
    ledger = made(spark, 60_000, name("A", F.col("id"), 300), name("C", F.col("id") + 7, 200))
    write_table(ledger, str(root / "by_account"), partitions=FILES)
    cluster_by_category(spark, str(root / "by_account"), str(root / "curve"), FILES)
    return root


def test_both_columns_skip_files(tables):
    accounts, categories = [f"A{i:03d}" for i in range(300)], [f"C{i:03d}" for i in range(200)]
    read, files = most_read(tables / "by_account", "MainCategory", categories)
    assert read == files > FILES // 2  # what an ingest leaves: a category reads every file
    for column, values in (("Account", accounts), ("MainCategory", categories)):
        read, files = most_read(tables / "curve", column, values)
        assert files > FILES // 2
        assert read <= files // 3  # the square root of 64 is 8; neighbouring ranges share files


def test_rows_and_reports_are_the_same(spark, tables):
    plain, curve = (read_table(spark, str(tables / t)) for t in ("by_account", "curve"))
    assert curve.schema == plain.schema
    assert plain.exceptAll(curve).isEmpty() and curve.exceptAll(plain).isEmpty()

    def answers(ledger):
        frames = (
            select_category(ledger, "C017"),
            select_transactions(ledger, "A033", "C150", "2018", "03"),
            reports.history(ledger, "A001", year="2018"),
            reports.category_years(ledger, "C002"),
        )
        return [sorted(map(repr, frame.collect())) for frame in frames]

    assert answers(curve) == answers(plain)


def test_reader_gets_the_category_as_filter(spark, tables):
    plan = select_category(read_table(spark, str(tables / "curve")), "C017")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(MainCategory,C017)" in text


def test_hot_cell_is_split(spark, tmp_path):
    hot = F.col("id") % 2 == 0
    ledger = made(
        spark,
        20_000,
        F.when(hot, "hot").otherwise(name("A", F.col("id"), 50)),
        F.when(hot, "hot").otherwise(name("C", F.col("id"), 50)),
    )
    write_table(ledger, str(tmp_path / "table"), partitions=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cluster_by_category(spark, str(tmp_path / "table"), str(tmp_path / "curve"), 16)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [
        pq.ParquetFile(file).metadata.num_rows
        for file in (tmp_path / "curve").glob("Year=*/*.parquet")
    ]
    assert sum(sizes) == 20_000 and max(sizes) <= 20_000 // 16 * 2


def test_blank_single_and_no_values(spark, tmp_path):
    text = ",".join(LEDGER_COLUMNS) + "\n"
    (tmp_path / "csv").mkdir()
    lines = "01/02/2018,t,,,Credit,,-1.00,5.00\n" * 3
    (tmp_path / "csv" / "one.csv").write_text(text + lines)
    table = str(tmp_path / "table")
    ledger = ingest(spark, str(tmp_path / "csv"), table)
    curve = cluster_by_category(spark, table, str(tmp_path / "curve"))
    assert sorted(map(repr, curve.collect())) == sorted(map(repr, ledger.collect()))
    write_table(ledger.limit(0), str(tmp_path / "none"))
    empty = cluster_by_category(spark, str(tmp_path / "none"), str(tmp_path / "none_curve"))
    assert empty.count() == 0 and empty.columns == ledger.columns


def test_ranges_and_curve(spark):
    values = ["", "b", "d", "é", "z"]
    frame = spark.createDataFrame([(v,) for v in [None, *values, "a", "c", "zz"]], "Account string")
    starts = range_starts(frame, "Account")
    assert starts == ["", "a", "b", "c", "d", "z", "zz", "é"]  # the order of bytes
    assert len(range_starts(frame, "Account", 3)) <= 3
    assert range_starts(frame.limit(0), "Account") == []
    places = frame.select("Account", range_number(F.col("Account"), starts).alias("n")).collect()
    assert {r["Account"]: r["n"] for r in places if r["Account"]} == {
        s: i for i, s in enumerate(starts) if s
    }
    assert [r["n"] for r in places if not r["Account"]] == [0, 0]
    grid = spark.range(64).select((F.col("id") % 8).alias("x"), F.expr("id div 8").alias("y"))
    numbers = grid.select("x", "y", z_order(F.col("x"), F.col("y"), 3).alias("z")).collect()
    assert sorted(r["z"] for r in numbers) == list(range(64))
    for r in numbers:
        bits = "".join(a + b for a, b in zip(f"{r['x']:03b}", f"{r['y']:03b}"))
        assert r["z"] == int(bits, 2)
