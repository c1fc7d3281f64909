"""Column expressions on literal values."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallybook.functions import dates, money


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def on(spark, make, text):
    frame = spark.createDataFrame([(text,)], "x string")
    return frame.select(make(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, year, month, parts, index, code",
    [
        ("01/05/2018", "2018", "01", ("01", "05", "2018"), 0, "01"),
        ("12/31/2017", "2017", "12", ("12", "31", "2017"), 11, "12"),
        # unpadded text: the substrings are literal, the parts are not
        ("1/5/2018", "18", "1/", ("1", "5", "2018"), 0, "01"),
    ],
)
def test_dates(spark, text, year, month, parts, index, code):
    assert on(spark, dates.year_text, text) == year
    assert on(spark, dates.month_text, text) == month
    split = (dates.split_month, dates.split_day, dates.split_year)
    assert tuple(on(spark, f, text) for f in split) == parts
    assert on(spark, dates.month_index, text) == index
    assert on(spark, dates.month_code, text) == code


def test_date_errors(spark):
    for make, text in [
        (dates.split_day, "2018"),
        (dates.month_index, "x/1/2018"),
        (dates.month_code, "13/01/2018"),
        (dates.month_code, "00/01/2018"),
        (dates.month_code, "2018-01-02"),
    ]:
        with pytest.raises(PySparkException):
            on(spark, make, text)


def test_normalized_and_real_dates(spark):
    assert on(spark, dates.normalized_date, "1/5/2018") == "01/05/2018"
    assert on(spark, dates.normalized_date, "01/05/2018") == "01/05/2018"
    assert str(on(spark, dates.ledger_date, "1/5/2018")) == "2018-01-05"
    assert str(on(spark, dates.ledger_date, "12/31/2018")) == "2018-12-31"
    assert on(spark, dates.ledger_date, "soon") is None


def test_month_labels(spark):
    labels = [value(spark, dates.month_label(F.lit(c))) for c in ("00", "01", "12", "13")]
    assert labels == ["All", "JAN", "DEC", None]


def test_parse_money(spark):
    assert on(spark, money.parse_money, "-12.50") == Decimal("-12.50")
    assert on(spark, money.parse_money, " 7 ") == Decimal("7.00")
    assert on(spark, money.parse_money, "") is None
    assert on(spark, money.parse_money, "  ") is None
    assert on(spark, money.parse_money, None) is None
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            for junk in ("1,234.5", "abc", "$3", "1" * 20):
                with pytest.raises(PySparkException, match="no amount"):
                    on(spark, money.parse_money, junk)
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_magnitude_rounds_half_away_from_zero(spark):
    for text, wanted in [("155.125", "155.13"), ("-155.125", "155.13"), ("2.675", "2.68"),
                         ("-0.004", "0.00"), ("0", "0.00")]:
        amount = F.lit(text).cast("decimal(20,6)")
        assert value(spark, money.magnitude(amount)) == Decimal(wanted)


def test_exact_mean_keeps_enough_decimals(spark):
    # 0.01 over 3: rounding the mean to 6 digits first could not be told from a tie elsewhere
    mean = value(spark, money.exact_mean(F.lit("0.01").cast("decimal(38,2)"), F.lit(3)))
    assert mean == Decimal("0.0033333333333")


@pytest.mark.parametrize(
    "x, wanted",
    [("0.03", 0.03), ("0.0347", 0.03), ("-1234", -1000.0), ("95", 100.0), ("0.7", 0.7),
     ("250", 300.0), ("-250", -300.0), ("1000", 1000.0), ("999.99", 1000.0), ("0", 0.0),
     ("1", 1.0), ("0.95", 1.0), ("123456789012.34", 1e11)],
)
def test_round_to_one_digit(spark, x, wanted):
    amount = F.lit(x).cast("decimal(18,4)")
    assert value(spark, money.round_to_one_digit(amount)) == wanted
