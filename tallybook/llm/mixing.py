"""Mixing documents to target weights, with DataFrame functions alone.

Tokens are counted by cell, a combination of the values of all margins (source, language, topic).
Iterative proportional fitting scales the cells by one margin after the other until the tokens of
every margin have their target shares. A document is then sampled with its cell's factor, scaled
so that the greatest is 1: what is drawn has the target shares in expectation, nothing is drawn
twice, and as much as possible is kept.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.storage import stored

ROUNDS = 12
_ROUNDS_PER_TABLE = 4
# Cells are broadcast up to this number (under 20 MB), and joined with salts beyond it.
BROADCAST_CELLS = 100_000
SALTS = 32
# Weights that sum to 1 but for rounding.
_NOTHING_LEFT = 1e-9
_SPACE_RUNS = r"[\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Number of words, runs of characters other than white space; null as empty."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(words, _SPACE_RUNS, "")).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse kind of content, told by what is in the text; the first that applies."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.rlike(r"[$%&*#]{3}"), "symbols")
        .when(text.contains("!!"), "shouting")
        .when(text.contains(" | "), "list")
        .when(text.rlike("[0-9]"), "figures")
        .otherwise("prose")
    )


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | float],
    tokens: Column,
    draw: Column,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Add ``tokens``, ``probability`` and ``sampled`` to every row.

    ``targets`` has for each margin column either the weights of its values or a power: the
    values' own shares to that power (0 makes them even, 1 keeps them). Values without a weight
    share what the weights leave of 1; where these leave nothing, such values keep their own share
    and the weights divide the rest. Weighted values without documents give theirs up. ``draw`` is
    the row's number in [0, 1) that its probability is held against.

    A null value of a margin is a value like others. Documents without tokens weigh nothing and
    are sampled with their cell's probability; cells without any token have probability 1. Given
    columns called like the new ones are replaced. An empty table gives no rows.
    """
    margins = list(targets)
    docs = docs.withColumn("tokens", tokens.cast("bigint"))
    cells = stored(
        docs.groupBy(*margins).agg(F.sum("tokens").alias("_own")).where("_own > 0"), "cells"
    )
    n_cells, total = cells.agg(F.count("*"), F.sum("_own").cast("double")).first()
    few = n_cells <= BROADCAST_CELLS
    cells = cells.withColumn("_weight", F.col("_own") / F.lit(total or 1.0))
    for margin, wanted in targets.items():
        shares = _targets(cells, margin, wanted)
        cells = cells.join(shares, cells[margin].eqNullSafe(F.col("_value"))).drop("_value")
    for number in range(rounds):
        if number % _ROUNDS_PER_TABLE == 0:
            cells = stored(cells, "raked")
            # Few cells are raked in one task, without exchanges.
            cells = cells.coalesce(1) if few else cells
        for margin in margins:
            cells = cells.withColumn(
                "_weight",
                # A value whose cells are all down to nothing stays there.
                F.coalesce(
                    F.try_divide(
                        F.col("_weight") * F.col(f"_to_{margin}"),
                        F.sum("_weight").over(Window.partitionBy(margin)),
                    ),
                    F.lit(0.0),
                ),
            )
    factors = stored(
        cells.select(*margins, (F.col("_weight") / F.col("_own")).alias("_factor")), "factors"
    )
    greatest = factors.agg(F.max("_factor")).first()[0] or 1.0

    docs = docs.drop("probability", "sampled")
    theirs = factors.select(
        *[F.col(m).alias(f"_{m}") for m in margins],
        (F.col("_factor") / F.lit(greatest)).alias("probability"),
    )
    same = F.lit(True)
    for margin in margins:
        same &= docs[margin].eqNullSafe(F.col(f"_{margin}"))
    if few:
        joined = docs.join(F.broadcast(theirs), same, "left")
    else:
        salted = docs.withColumn("_salt", F.pmod(F.xxhash64(draw), F.lit(SALTS)).cast("int"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        copies = theirs.select("*", salts.alias("_of_salt"))
        joined = salted.join(copies, same & (F.col("_salt") == F.col("_of_salt")), "left")
    probability = F.coalesce("probability", F.lit(1.0))
    return joined.select(
        *docs.columns, probability.alias("probability"), (draw < probability).alias("sampled")
    )


def _targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | float) -> DataFrame:
    """The share each value of a margin shall have; together they make 1."""
    values = cells.groupBy(F.col(margin).alias("_value")).agg(F.sum("_weight").alias("_share"))
    if not isinstance(wanted, Mapping):
        share = F.pow("_share", F.lit(float(wanted)))
    else:
        weight = F.lit(None).cast("double")
        for name, given in wanted.items():
            weight = F.when(F.col("_value") == name, F.lit(float(given))).otherwise(weight)
        # What the weights leave goes to the values that have none.
        rest = 1.0 - sum(wanted.values())
        free = values.where(weight.isNull()).agg(F.sum("_share")).first()[0] or 0.0
        if free and rest < _NOTHING_LEFT:
            listed = values.agg(F.sum(weight)).first()[0] or 1.0
            share = F.coalesce(weight * F.lit((1.0 - free) / listed), F.col("_share"))
        else:
            share = F.coalesce(weight, F.lit(max(0.0, rest)) * F.col("_share") / F.lit(free or 1.0))
    total = values.agg(F.sum(share)).first()[0] or 1.0
    return values.select("_value", (share / F.lit(total)).alias(f"_to_{margin}"))
