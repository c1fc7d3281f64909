"""Expressions over the ledger's ``MM/DD/YYYY`` date text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.schema import MONTH_CODES, MONTH_LABELS


_PLAIN_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"


def year_text(date: Column) -> Column:
    """Characters 7-10 of the date text; selectors compare this literally."""
    return F.substring(date, 7, 4)


def month_text(date: Column) -> Column:
    """Characters 1-2 of the date text."""
    return F.substring(date, 1, 2)


def split_month(date: Column) -> Column:
    return F.element_at(F.split(date, "/"), 1)


def split_day(date: Column) -> Column:
    return F.element_at(F.split(date, "/"), 2)


def split_year(date: Column) -> Column:
    return F.element_at(F.split(date, "/"), 3)


def month_index(date: Column) -> Column:
    """Zero-based month, from padded or unpadded text."""
    return _first_part(date).cast("int") - F.lit(1)


def month_code(date: Column) -> Column:
    """Two-digit month from padded or unpadded text; a month outside 1..12 is an error."""
    text = _first_part(date)
    number = text.cast("int")
    return (
        # Nearly every date is padded; looking its month up is cheaper than parsing it.
        F.when(text.isin(*MONTH_CODES), text)
        .when(number.between(1, 12), F.lpad(number.cast("string"), 2, "0"))
        .otherwise(F.raise_error(F.concat(F.lit("month is not within 1..12: "), date)))
    )


def month_label(code: Column) -> Column:
    """Label of a month code; NULL for an unknown code."""
    pairs = [F.lit(x) for pair in MONTH_LABELS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def normalized_date(date: Column) -> Column:
    """Pad month and day to two digits.

    A blank date stays as it is; any other text that is not one or two digits, one or two digits
    and four digits, as a year of two digits, is an error.
    """
    padded = F.concat_ws(
        "/", F.lpad(split_month(date), 2, "0"), F.lpad(split_day(date), 2, "0"), split_year(date)
    )
    return (
        F.when(date.rlike(_PLAIN_DATE), padded)
        .when(is_plain_date(date), date)
        .otherwise(F.raise_error(F.concat(F.lit("not a date month/day/year: "), date)))
    )


def is_plain_date(date: Column) -> Column:
    """Whether the text can be padded, or is blank."""
    return date.isNull() | (F.trim(date) == "") | date.rlike(_PLAIN_DATE)


def ledger_date(date: Column) -> Column:
    """Real date, for ordering only; NULL where the text is not a date."""
    return F.try_to_date(date, "M/d/yyyy")


def current_year() -> Column:
    return F.year(F.current_date()).cast("string")


def _first_part(date: Column) -> Column:
    return F.substring_index(date, "/", 1)
