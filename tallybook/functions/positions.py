"""The place of a line among all ingested lines, as one number.

The highest bits have the batch (one per ingest, or per ledger of a union), the others an offset
within the batch: every file has a range of offsets of its own, in the order of the files, and a
line its place in that range. A part that does not fit raises, it never wraps.
"""

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.schema import POSITION

BATCH_BITS, OFFSET_BITS = 12, 51
_BATCHES = "batches"


def file_starts(widths: Sequence[int]) -> list[int]:
    """Where the ranges of files that take up so many offsets begin, one after the other."""
    starts = [0, *accumulate(widths)]
    if starts[-1] > 1 << OFFSET_BITS:
        raise ValueError(
            f"a batch has {1 << OFFSET_BITS} offsets, these {len(widths)} files take {starts[-1]}"
        )
    return starts[:-1]


def position(batch: int, start: Column, width: Column, line: Column) -> Column:
    """The position of a line, given the range of its file and its place there."""
    fits = start.isNotNull() & (line >= 0) & (line < width)
    return F.when(fits, F.lit(_start(batch)) + start + line).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("no place in the file for line"), line))
    )


def of_batch(batch: int) -> Column:
    """Whether a row of the table belongs to that batch, as a range of positions."""
    return F.col(POSITION).between(_start(batch), _start(batch) + (1 << OFFSET_BITS) - 1)


def first_of_batch(batch: int) -> int:
    """The least position of a batch."""
    return _start(batch)


def batch_of(value: int) -> int:
    return value >> OFFSET_BITS


def in_batches(column: Column, batches: int) -> Column:
    """Note along with the position column how many batches it may hold."""
    return column.alias(POSITION, metadata={_BATCHES: batches})


def batches_of(ledger: DataFrame) -> int:
    """How many batches the positions take up; asked of the rows where it is not noted."""
    noted = ledger.schema[POSITION].metadata.get(_BATCHES)
    if noted is not None:
        return noted
    last = ledger.agg(F.max(POSITION)).first()[0]
    return 0 if last is None else batch_of(last) + 1


def after(column: Column, batches: int) -> Column:
    """The position moved behind so many batches; too many of them are an overflow error."""
    return column + F.lit(batches << OFFSET_BITS)


def _start(batch: int) -> int:
    if not 0 <= batch < 1 << BATCH_BITS:
        raise ValueError(f"a table takes {1 << BATCH_BITS} batches, this is number {batch}")
    return batch << OFFSET_BITS
