"""Reading and writing ledgers."""

import gzip
import json
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

import golden
from tallybook.functions.positions import after, file_starts, position
from tallybook.operators import balances, dimensions, totals
from tallybook.operators.selection import select_category, select_transactions
from tallybook.plans import reports
from tallybook.plans.ingest import BadLines, ingest
from tallybook.schema import LEDGER_COLUMNS, POSITION
from tallybook.sources.exports import (
    bad_lines,
    read_combined,
    read_exports,
    typed_ledger,
    union_all,
)
from tallybook.sources.sql import fetch, register
from tallybook.sources.tables import read_table, write_combined, write_records, write_table

HEADER = "Date,Title,Comment,MainCategory,Subcategory,Account,Amount,Balance\n"


def row(**cells):
    base = dict(
        Date="01/02/2018", Title="t", Comment="", MainCategory="Food", Subcategory="Credit",
        Account="A", Amount="-1.00", Balance="5.00",
    )
    return ",".join({**base, **cells}.values()) + "\n"


@pytest.fixture
def folder(tmp_path):
    return golden.write(
        tmp_path / "csv", checking=golden.CHECKING, savings=golden.SAVINGS
    )


def lines(frame):
    return [tuple(r) for r in frame.orderBy(POSITION).select(*LEDGER_COLUMNS).collect()]


def test_reads_plain_files_only(spark, tmp_path, folder):
    golden.write(tmp_path / "csv" / "old", deep="a,b\n1,2\n")
    golden.write(tmp_path / "csv" / "Account=Checking", deep="a,b\n1,2\n")
    (tmp_path / "csv" / "_SUCCESS").write_text("")
    (tmp_path / "csv" / ".checking.csv.crc").write_text("x")
    (tmp_path / "csv" / "no_suffix").write_text(HEADER + row(Title="plain"))
    rows = read_exports(spark, folder)
    assert rows.columns == [*LEDGER_COLUMNS, POSITION]
    assert rows.count() == 11
    assert read_exports(spark, folder + "/").count() == 11
    assert read_exports(spark, f"file://{folder}").count() == 11
    assert rows.where("Title = 'plain'").count() == 1


@pytest.mark.parametrize("hidden", ["_two.csv", ".three.csv", "four.csv._COPYING_"])
@pytest.mark.parametrize("alone", [False, True])
def test_a_file_spark_would_pass_over_is_an_error(spark, tmp_path, hidden, alone):
    if not alone:
        golden.write(tmp_path / "csv", one=HEADER + row())
    golden.write(tmp_path / "csv", x=HEADER + row())
    (tmp_path / "csv" / "x.csv").rename(tmp_path / "csv" / hidden)
    for read in (read_exports, read_combined):
        with pytest.raises(ValueError, match=hidden):
            read(spark, str(tmp_path / "csv"))


def test_names_are_no_patterns(spark, tmp_path):
    folder = golden.write(
        tmp_path / "c[s]v*", **{"a[1]": HEADER + row(Title="one"), "a{2} b%20": HEADER + row(Title="two"), "a1": HEADER + row()}
    )
    assert sorted(r.Title for r in read_exports(spark, folder).collect()) == ["one", "t", "two"]


def test_folder_without_files(spark, tmp_path):
    golden.write(tmp_path / "csv" / "deep" / "er", one=HEADER + row())
    assert read_exports(spark, str(tmp_path / "csv")).collect() == []
    with pytest.raises(ValueError):
        read_combined(spark, str(tmp_path / "csv"))
    with pytest.raises(Py4JJavaError):
        read_exports(spark, str(tmp_path / "nowhere"))


def test_columns_are_bound_by_position(spark, folder):
    first = lines(read_exports(spark, folder))[0]
    assert first == (
        "01/05/2017", "Pay", "", "Salary", "Debit", "Checking", "1000.00", "1000.00",
    )


@pytest.mark.parametrize("text", ["a,b\n1,2\n", HEADER + "01/02/2018,short\n"])
def test_wrong_column_count_fails(spark, tmp_path, folder, text):
    golden.write(tmp_path / "csv", bad=text)
    rows = read_exports(spark, folder)
    for action in (rows.count, rows.select("Title").collect, rows.collect):
        with pytest.raises(Py4JJavaError, match="MALFORMED|NO_HINT"):
            action()


def test_bad_later_file_fails_the_ingest(spark, tmp_path, folder):
    golden.write(tmp_path / "csv", zzz=HEADER + row(Amount='"1,234.50"'))
    with pytest.raises(PySparkException):
        ingest(spark, folder, str(tmp_path / "table"))


def test_blanks(spark, tmp_path):
    folder = golden.write(
        tmp_path / "csv", one=HEADER + row(MainCategory="", Amount="", Balance="") + row()
    )
    ledger = typed_ledger(read_exports(spark, folder))
    assert [r.MainCategory for r in ledger.where("Amount IS NULL").collect()] == [""]
    assert [r.value for r in dimensions.categories(ledger).collect()] == ["", "All", "Food"]
    share = dict(totals.category_share(ledger).collect())
    assert share == {"": Decimal(0), "Food": Decimal("1.00")}
    # the last balance that is there counts
    selection = select_transactions(ledger, year="2018")
    january = balances.month_end_balance(selection).where("Month = '01'").first()
    assert january.EndBalance == Decimal("5.00")


def test_texts_stay_as_they_are(spark, tmp_path):
    folder = golden.write(
        tmp_path / "csv",
        one=HEADER
        + row(MainCategory="NA", Account="001", Title='" a ""b"" \\ c"', Comment=" x ")
        + row(MainCategory="Kid's", Title='"p, q"'),
    )
    ledger = typed_ledger(read_exports(spark, folder))
    first, second = ledger.orderBy(POSITION).collect()
    assert (first.MainCategory, first.Account) == ("NA", "001")
    assert (first.Title, first.Comment) == (' a "b" \\ c', " x ")
    assert second.Title == "p, q"
    assert select_category(ledger, "Kid's").count() == 1
    names = [r.value for r in dimensions.account_categories(ledger, "001").collect()]
    assert names == ["All", "NA"]
    out = str(tmp_path / "combined")
    write_combined(ledger, out)
    again = typed_ledger(read_combined(spark, out))
    assert lines(again) == lines(ledger)


def test_line_breaks_inside_quotes(spark, tmp_path):
    folder = golden.write(
        tmp_path / "csv", one=HEADER + row(Title='"a\nb"') + row(), two=HEADER + row(Title="z")
    )
    with pytest.raises(Py4JJavaError, match="MALFORMED"):
        read_exports(spark, folder).collect()
    titles = [r[1] for r in lines(read_exports(spark, folder, multi_line=True))]
    assert titles == ["a\nb", "t", "z"]


def test_unpadded_dates(spark, tmp_path):
    folder = golden.write(tmp_path / "csv", one=HEADER + row(Date="1/5/2018"))
    raw = read_exports(spark, folder)
    literal = typed_ledger(raw)
    assert [r.value for r in dimensions.years(literal).collect()] == ["18"]
    assert totals.year_month_pivot(select_category(literal)).first().Year == "2018"
    assert [r.label for r in dimensions.months_in_use(literal).orderBy("code").collect()] == ["All", "1/"]
    padded = typed_ledger(raw, normalize_dates=True)
    assert (padded.first().Date, padded.first().Year) == ("01/05/2018", "2018")


def test_account_called_all_is_listed_twice(spark, tmp_path):
    folder = golden.write(tmp_path / "csv", one=HEADER + row(Account="All"))
    ledger = typed_ledger(read_exports(spark, folder))
    assert [r.value for r in dimensions.accounts(ledger).collect()] == ["All", "All"]


def test_line_order_survives_file_splits(spark, tmp_path):
    texts = {
        name: HEADER + "".join(row(Title=f"{name}{i:05d}") for i in range(4000))
        for name in ("a", "b")
    }
    folder = golden.write(tmp_path / "csv", **texts)
    split_bytes = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_exports(spark, folder)
        assert rows.rdd.getNumPartitions() > 8
        titles = [r[1] for r in lines(rows)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    assert titles == [f"{name}{i:05d}" for name in ("a", "b") for i in range(4000)]


def test_combined_file_by_header_name(spark, tmp_path, folder):
    out = str(tmp_path / "combined")
    ledger = typed_ledger(read_exports(spark, folder))
    write_combined(ledger, out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "combined").glob("part-*")))
    assert text.startswith(HEADER)
    assert lines(typed_ledger(read_combined(spark, out))) == lines(ledger)

    (tmp_path / "wide.csv").write_text(
        "Balance,Extra,Amount,Account,Subcategory,MainCategory,Comment,Title,Date\n"
        "9.00,x,-1.00,A,Credit,Food,,t,01/02/2018\n"
    )
    wide = read_combined(spark, str(tmp_path / "wide.csv"))
    assert lines(wide) == [
        ("01/02/2018", "t", "", "Food", "Credit", "A", "-1.00", "9.00"),
    ]


def test_table_is_partitioned_by_year_text(spark, tmp_path, folder):
    path = str(tmp_path / "table")
    ledger = ingest(spark, folder, path)
    assert {p.name for p in (tmp_path / "table").glob("Year=*")} == {"Year=2017", "Year=2018"}
    assert dict(ledger.dtypes)["Year"] == "string"
    assert lines(ledger) == lines(typed_ledger(read_exports(spark, folder)))
    with pytest.raises(PySparkException):
        ingest(spark, folder, path)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (tmp_path / "csv" / "checking.csv").unlink()  # the only file with 2017
        assert ingest(spark, folder, path, mode="overwrite").count() == 3
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_files_of_the_table_hold_short_ranges_of_accounts(spark, tmp_path):
    text = "".join(
        row(Account="hot" if i % 3 == 0 else f"A{i * 7 % 40:02d}", Date=f"{i % 12 + 1:02d}/05/2018")
        for i in range(4000)
    )
    ledger = typed_ledger(read_exports(spark, golden.write(tmp_path / "csv", one=HEADER + text)))
    write_table(ledger, str(tmp_path / "table"), partitions=10)
    held = {}
    for file in (tmp_path / "table" / "Year=2018").glob("*.parquet"):
        footer = pq.ParquetFile(file).metadata
        columns = footer.schema.names
        place = columns.index("Account")
        stats = [footer.row_group(g).column(place).statistics for g in range(footer.num_row_groups)]
        held[file.name] = {s.min for s in stats} | {s.max for s in stats}
        rows = pq.read_table(file, columns=["Account", "Month", POSITION]).to_pylist()
        keys = [tuple(r.values()) for r in rows]
        assert keys == sorted(keys)
    assert len(held) > 5
    # the hot account lies in several files, any other in two at most; no file spans them all
    accounts = [(min(a), max(a)) for a in held.values()]
    assert sum(low <= "hot" <= high for low, high in accounts) >= 3
    for account in {f"A{i:02d}" for i in range(40)}:
        assert sum(low <= account <= high for low, high in accounts) <= 2


def test_appended_lines_come_after_those_of_the_table(spark, tmp_path):
    table = str(tmp_path / "table")
    one = golden.write(tmp_path / "one", checking=HEADER + row(Balance="7.00") + row(Balance="9.00"))
    two = golden.write(tmp_path / "two", checking=HEADER + row(Balance="5.00"))
    ingest(spark, one, table, mode="append")
    ledger = ingest(spark, two, table, mode="append")
    for order in ("ingest", "date"):
        january = balances.month_end_balance(ledger, order).where("Month = '01'").first()
        assert january.EndBalance == Decimal("5.00")
    assert ledger.select(POSITION).distinct().count() == 3
    third = ingest(spark, one, table, mode="append")
    assert third.where("Balance = 9").agg(F.max(POSITION)).first()[0] >> 51 == 2


def test_positions_that_do_not_fit_raise(spark):
    one = spark.range(1)
    top = 1 << 51

    def place(batch, start, width, line):
        columns = [F.lit(x).cast("bigint") for x in (start, width, line)]
        return one.select(position(batch, *columns))

    assert place(4095, top - 5, 5, 4).first()[0] == (1 << 63) - 1
    with pytest.raises(ValueError):
        place(4096, 0, 1, 0)
    for start, width, line in ((0, 5, 5), (0, 5, -1), (None, None, 0)):
        with pytest.raises(PySparkException, match="no place"):
            place(0, start, width, line).collect()
    with pytest.raises(PySparkException, match="OVERFLOW"):
        one.select(after(position(4095, F.lit(0), F.lit(1), F.lit(0)), 1)).collect()


def test_ranges_of_files_follow_each_other_and_too_many_bytes_raise():
    assert file_starts([]) == []
    assert file_starts([3, 1, 5]) == [0, 3, 4]
    assert file_starts([1 << 50, 1 << 50]) == [0, 1 << 50]
    with pytest.raises(ValueError, match="offsets"):
        file_starts([1 << 50, 1 << 50, 1])


def test_ten_thousand_files_are_ingested_in_the_order_of_their_names(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for i in range(10_000):
        (folder / f"f{i:05d}.csv").write_text(HEADER + row(Title=f"{i:05d}", Balance=f"{i}.00"))
    ledger = ingest(spark, str(folder), str(tmp_path / "table"))
    titles = [r.Title for r in ledger.orderBy(POSITION).select("Title").collect()]
    assert titles == [f"{i:05d}" for i in range(10_000)]
    january = balances.month_end_balance(ledger).where("Month = '01'").first()
    assert january.EndBalance == Decimal("9999.00")


def test_many_lines_before_a_short_file_in_one_task(spark, tmp_path):
    # One task reads the long file first; the lines of the short ones are numbered after its lines.
    texts = {"b": HEADER + row(Title="b") * 3000, "a": HEADER + row(Title="a"), "c": HEADER + row(Title="c")}
    rows = read_exports(spark, golden.write(tmp_path / "csv", **texts))
    assert [r[1] for r in lines(rows)] == ["a", *["b"] * 3000, "c"]
    assert rows.select(POSITION).distinct().count() == 3002


def test_compressed_exports(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    for name in ("b", "a"):
        text = HEADER + "".join(row(Title=f"{name}{i:05d}") for i in range(5000))
        (tmp_path / "csv" / f"{name}.csv.gz").write_bytes(gzip.compress(text.encode()))
    titles = [r[1] for r in lines(read_exports(spark, str(tmp_path / "csv")))]
    assert titles == [f"{name}{i:05d}" for name in "ab" for i in range(5000)]


def test_combined_files_go_by_their_own_headers(spark, tmp_path):
    golden.write(tmp_path / "c", a=HEADER + row(Title="A") + row(Title="A2"))
    (tmp_path / "c" / "b.csv").write_text(
        "title,Extra,Date,Comment,MainCategory,Subcategory,Account,Balance,Amount\n"
        "B,x,01/06/2018,,Food,Credit,A,8.00,-1.00\n"
    )
    (tmp_path / "c" / "c.csv").write_text("\n" + HEADER + row(Title="C"))
    (tmp_path / "c" / "d.csv").write_text("")
    found = lines(read_combined(spark, str(tmp_path / "c")))
    assert [line[1] for line in found] == ["A", "A2", "B", "C"]
    assert found[2] == ("01/06/2018", "B", "", "Food", "Credit", "A", "-1.00", "8.00")

    for bad in ("Title,Date\nx,y\n", HEADER.replace("Title", "Date") + row()):
        (tmp_path / "c" / "wrong.csv").write_text(bad)
        with pytest.raises(ValueError, match="wrong.csv"):
            read_combined(spark, str(tmp_path / "c"))


def test_combined_files_without_a_line(spark, tmp_path):
    golden.write(tmp_path / "c", a="", b="\n\n")
    assert read_combined(spark, str(tmp_path / "c")).collect() == []


def bad_folder(tmp_path):
    return golden.write(
        tmp_path / "csv",
        a=HEADER + row() + "01/02/2018,short\n" + row(Amount='"1,234.50"', Balance="x"),
        b=HEADER + row() + row(Date="2018-01-02") + "1,2,3,4,5,6,7,8,9\n",
    )


def test_all_bad_lines_are_found(spark, tmp_path):
    folder = bad_folder(tmp_path)
    found = bad_lines(spark, folder, normalize_dates=True).orderBy(POSITION, "Reason").collect()
    assert [(r.File, r.Reason, r.Text) for r in found] == [
        ("a.csv", "fields", "01/02/2018,short"),
        ("a.csv", "Amount", "1,234.50"),
        ("a.csv", "Balance", "x"),
        ("b.csv", "Date", "2018-01-02"),
        ("b.csv", "fields", "1,2,3,4,5,6,7,8,9"),
    ]
    assert bad_lines(spark, folder).where("Reason = 'Date'").count() == 0
    good = golden.write(tmp_path / "good", a=HEADER + row(Amount="", Balance=" ") + row())
    assert bad_lines(spark, good, normalize_dates=True).collect() == []


def test_an_ingest_names_all_bad_lines_and_writes_nothing(spark, tmp_path):
    folder = bad_folder(tmp_path)
    with pytest.raises(BadLines, match="4 bad lines") as raised:
        ingest(spark, folder, str(tmp_path / "table"))
    assert raised.value.count == 4
    assert raised.value.lines[0] == ("a.csv", "fields", "01/02/2018,short")
    assert "b.csv: fields: 1,2,3,4,5,6,7,8,9" in str(raised.value)
    assert not list((tmp_path / "table").glob("Year=*"))


@pytest.mark.parametrize("text", ["-1.004", "10.005", "1.0001e1", "1e-30", "1.00000000000000000001", "1e40"])
def test_amounts_that_do_not_fit_raise(spark, tmp_path, text):
    folder = golden.write(tmp_path / "csv", one=HEADER + row(Amount=text))
    raw = read_exports(spark, folder)
    with pytest.raises(PySparkException, match="no amount"):
        typed_ledger(raw).collect()
    if text in ("-1.004", "10.005"):
        assert typed_ledger(raw, money=DecimalType(18, 4)).first().Amount == Decimal(text)


def test_amounts_that_fit(spark, tmp_path):
    texts = ["-1.00", "-1.000", "1e3", "1.25e1", "+7", ".5", "12345678901234.56"]
    folder = golden.write(tmp_path / "csv", one=HEADER + "".join(row(Amount=t) for t in texts))
    found = typed_ledger(read_exports(spark, folder)).orderBy(POSITION).collect()
    assert [r.Amount for r in found] == [Decimal(t) for t in texts]
    with pytest.raises(ValueError):
        ingest(spark, folder, str(tmp_path / "table"), money=DecimalType(18, 5))


@pytest.mark.parametrize("text", ["123/4/2018", "1/015/2018", "2018/01/05", "1/5/18", "x"])
def test_dates_that_padding_would_cut_raise(spark, tmp_path, text):
    raw = read_exports(spark, golden.write(tmp_path / "csv", one=HEADER + row(Date=text)))
    with pytest.raises(PySparkException, match="not a date"):
        typed_ledger(raw, normalize_dates=True).collect()
    assert typed_ledger(raw).first().Date == text


def test_blank_year_survives_the_table(spark, tmp_path):
    folder = golden.write(tmp_path / "csv", one=HEADER + row(Date="1/1/18") + row(Date="x"))
    ledger = ingest(spark, folder, str(tmp_path / "table"))
    assert {r.Year for r in ledger.collect()} == {"", ""} | {"1/1/18"[6:10]}
    assert select_transactions(ledger, year="").count() == 2


def test_hot_year_is_split_over_files(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 10 == 0, "01/02/2017").otherwise("01/02/2018").alias("Date"),
        F.lit("t").alias("Title"),
        F.lit("").alias("Comment"),
        F.lit("Food").alias("MainCategory"),
        F.lit("Credit").alias("Subcategory"),
        F.lit("A").alias("Account"),
        F.lit("-1.00").alias("Amount"),
        F.lit("1.00").alias("Balance"),
        F.col("id").alias(POSITION),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_table(typed_ledger(rows), str(tmp_path / "table"), partitions=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = {y: len(list((tmp_path / "table" / f"Year={y}").glob("*.parquet")))
             for y in ("2017", "2018")}
    assert files["2018"] > 3
    assert read_table(spark, str(tmp_path / "table")).count() == 40_000


def test_union_all_keeps_duplicates(spark, folder):
    ledger = typed_ledger(read_exports(spark, folder))
    shuffled = ledger.select(*reversed(ledger.columns))
    assert union_all(ledger, shuffled, ledger).count() == 30
    assert union_all(ledger).count() == 10


def test_union_all_keeps_the_order_of_its_ledgers(spark, tmp_path):
    older, newer = (
        typed_ledger(
            read_exports(
                spark, golden.write(tmp_path / name, same=HEADER + row(Balance=balance))
            )
        )
        for name, balance in (("older", "1.00"), ("newer", "2.00"))
    )
    for ledgers, last in (((older, newer), "2.00"), ((newer, older), "1.00")):
        both = union_all(*ledgers)
        nested = union_all(both, ledgers[1])
        for ledger in (both, nested):
            closing = balances.month_end_balance(ledger).where("Month = '01'").first()
            assert closing.EndBalance == Decimal(last)


def test_finer_money(spark, tmp_path):
    folder = golden.write(
        tmp_path / "csv", one=HEADER + row(Amount="-1.2345", Balance="9.8765")
    )
    fine = ingest(spark, folder, str(tmp_path / "table"), money=DecimalType(18, 4))
    history = reports.history(fine, year="2018").where("Month = '01'")
    assert {r.Series: r.Value for r in history.collect()} == {
        "A": 9.8765, "Net Worth": 9.8765, "Expenses": -1.2345, "Income": 0.0,
        "Monthly Savings": -1.2345,
    }
    years = reports.category_years(fine).collect()
    assert {r.Label: r.Total for r in years} == {"2018": 1.23, "Mean of All Years": 1.23}


def test_sql_with_named_parameters(spark, folder):
    register(typed_ledger(read_exports(spark, folder)))
    query = "SELECT Title FROM ledger WHERE MainCategory = :category ORDER BY Title"
    assert [r.Title for r in fetch(spark, query, category="Transfer").collect()] == [
        "From checking", "To savings",
    ]
    assert fetch(spark, query, category="x' OR '1'='1").collect() == []


def test_records_sink(spark, tmp_path, folder):
    ledger = typed_ledger(read_exports(spark, folder)).where("Title = 'Fee'")
    write_records(
        ledger.select("Title", "Comment", F.lit(None).cast("string").alias("Note")),
        str(tmp_path / "json"),
    )
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    assert json.loads(text) == {"Title": "Fee", "Comment": "", "Note": None}
