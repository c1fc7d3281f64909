"""Expressions over amounts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallybook.schema import MONEY


def parse_money(text: Column, money: DecimalType = MONEY) -> Column:
    """Text to decimal: blank is missing, and any other text that is no number, or a number that
    the type cannot hold exactly, is an error."""
    return F.when(is_money(text, money), F.trim(text).try_cast(money)).otherwise(
        F.raise_error(F.concat(F.lit(f"no amount of type {money.simpleString()}: "), text))
    )


def is_money(text: Column, money: DecimalType = MONEY) -> Column:
    """Whether the text is blank or a number that the type holds exactly."""
    trimmed = F.trim(text)
    number = trimmed.try_cast(money)
    # The cast rounds. Digits behind the scale must be zeros; a number with an exponent must be
    # the same in wider types.
    cut = rf"^[^eE]*\.\d{{{money.scale}}}\d*[1-9][^eE]*$"
    same = (number == trimmed.try_cast("decimal(38,18)")) & (
        number.cast("double") == trimmed.try_cast("double")
    )
    exact = F.when(trimmed.rlike("[eE]"), same).otherwise(~trimmed.rlike(cut))
    fits = number.isNotNull() & exact
    return F.coalesce(fits, F.lit(False)) | text.isNull() | (trimmed == "")


def magnitude(amount: Column) -> Column:
    """Round to cents, halves away from zero, and drop the sign."""
    return F.abs(F.round(amount, 2))


def exact_mean(total: Column, count: Column) -> Column:
    """Mean of amounts of up to four decimals, kept to thirteen.

    Rounding it to cents afterwards cannot differ from rounding the mean itself.
    """
    return total.cast("decimal(26,4)") / count.cast("decimal(8,0)")


def round_to_one_digit(amount: Column) -> Column:
    """Keep the leading digit only; zero stays zero."""
    x = amount.cast("double")
    exponent = F.floor(F.log10(F.abs(x)))
    # Dividing by a power of ten keeps 0.7 at 0.7, where multiplying by 0.1 would not.
    scale = F.pow(F.lit(10.0), F.abs(exponent).cast("double"))
    rounded = F.when(exponent >= 0, F.round(x / scale, 0) * scale).otherwise(
        F.round(x * scale, 0) / scale
    )
    return F.when(x == 0, F.lit(0.0)).otherwise(rounded)


def money_as_double(frame: DataFrame) -> DataFrame:
    """Decimals are exact inside the operators; results leave as doubles."""
    return frame.selectExpr(
        *[
            f"CAST(`{f.name}` AS DOUBLE) AS `{f.name}`"
            if isinstance(f.dataType, DecimalType)
            else f"`{f.name}`"
            for f in frame.schema.fields
        ]
    )
