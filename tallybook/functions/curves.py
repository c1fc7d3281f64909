"""Places of values among ranges, and one number for the places of two columns."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_number(column: Column, starts: Sequence[str]) -> Column:
    """Which of the ranges that begin at ``starts``, ascending, a text lies in.

    Texts before the first start are in range 0 with it, and so is null. The ranges are searched
    by halves, so a row compares as often as their number has bits.
    """

    def within(low: int, high: int) -> Column:
        if high - low <= 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(starts[middle]), within(middle, high)).otherwise(
            within(low, middle)
        )

    return within(0, len(starts)).cast("bigint")


def z_order(one: Column, other: Column, bits: int) -> Column:
    """Two numbers of so many bits, interleaved: pairs that are near on the curve are near in both."""
    number = F.lit(0).cast("bigint")
    for bit in range(bits):
        for place, column in ((2 * bit + 1, one), (2 * bit, other)):
            number += F.shiftleft(F.shiftright(column, bit).bitwiseAND(F.lit(1)), place)
    return number
