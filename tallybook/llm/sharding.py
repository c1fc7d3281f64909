"""A uniform shuffle into shards of exact sizes.

Rows fall into blocks by a seeded hash. One matrix says how many rows of each block go to each
shard: its rows sum to the block sizes and its columns to the shard sizes, and it is drawn from
the (multivariate hypergeometric) law that a uniform shuffle of all rows would give it. Each block
is permuted and cut by its row of the matrix, the pieces are exchanged, and each shard is permuted
again.

Blocks and the cells of a shard hold about ``BLOCK_ROWS`` rows up to ``MOST_BLOCKS`` of them, and
more beyond that, so the matrix is bounded while no task ever needs a whole shard.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.storage import stored

BLOCK_ROWS = 4096
MOST_BLOCKS = 4096


def shuffle_into_shards(
    rows: DataFrame,
    n_shards: int,
    keys: Sequence[str] = ("doc_id",),
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``shard`` (0 to ``n_shards - 1``) and ``slot`` (0, 1, ... within the shard).

    Shard sizes differ by one row at most. ``keys`` tell rows apart; repeated rows and null keys
    are placed like any other, ties among equal keys in any order. Input columns called ``shard``
    or ``slot`` are replaced. No rows give no rows; fewer rows than shards leave shards empty.
    """
    rows = rows.drop("shard", "slot")
    total = rows.count()
    n_blocks = min(max(-(-total // block_rows), 1), MOST_BLOCKS)
    n_cells = min(max(-(-total // (block_rows * n_shards)), 1), MOST_BLOCKS // n_shards + 1)
    blocks = rows.withColumns(
        {
            "_block": F.pmod(_hash(keys, seed, "block"), F.lit(n_blocks)).cast("int"),
            "_order": _hash(keys, seed, "first"),
        }
    )
    sizes = dict(blocks.groupBy("_block").count().collect())  # n_blocks rows at most
    matrix = communication_matrix(
        [sizes.get(b, 0) for b in range(n_blocks)], shard_sizes(total, n_shards), seed
    )
    bounds = rows.sparkSession.createDataFrame(
        [(b, np.cumsum(row).tolist()) for b, row in enumerate(matrix)],
        "_block int, _bounds array<bigint>",
    )
    in_block = Window.partitionBy("_block").orderBy("_order", *keys)
    dealt = (
        blocks.withColumn("_rank", F.row_number().over(in_block) - 1)
        .join(F.broadcast(bounds), "_block")
        .withColumn("shard", F.size(F.filter("_bounds", lambda b: b <= F.col("_rank"))))
        .withColumn("_order", _hash(keys, seed, "second"))
        # Cells split the range of the order, so that they come one after the other in it.
        .withColumn("_cell", F.expr(f"int(shiftrightunsigned(_order, 33) * {n_cells} >> 31)"))
        .drop("_block", "_bounds", "_rank")
    )
    dealt = stored(dealt, "shards")
    ahead = Window.partitionBy("shard").orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = (
        dealt.groupBy("shard", "_cell")
        .count()
        .select("shard", "_cell", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    )  # n_shards * n_cells rows at most
    in_cell = Window.partitionBy("shard", "_cell").orderBy("_order", *keys)
    return (
        dealt.withColumn("_rank", F.row_number().over(in_cell) - 1)
        .join(F.broadcast(cells), ["shard", "_cell"])
        .withColumn("slot", F.col("_ahead") + F.col("_rank"))
        .select(*rows.columns, "shard", "slot")
    )


def shard_sizes(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]


def communication_matrix(rows: Sequence[int], columns: Sequence[int], seed: int) -> np.ndarray:
    """How many of each block's rows go to each shard, as a uniform shuffle would have it."""
    random = np.random.default_rng([seed, len(rows), len(columns)])
    room = np.array(columns, dtype=np.int64)
    matrix = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, size in enumerate(rows):
        left, others = int(size), int(room.sum())
        for j, capacity in enumerate(room):
            others -= int(capacity)
            matrix[i, j] = hypergeometric(random, int(capacity), others, left)
            left -= matrix[i, j]
        room -= matrix[i]
    return matrix


def hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, drawn without putting back, are good; for counts of any size.

    By inversion over the support, which is cut where the probability is below any double.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    share = good / (good + bad)
    spread = (draws * share * (1 - share)) ** 0.5
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    reach = int(40 * spread) + 60
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(ratios)])
    sums = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(sums, random.random() * sums[-1], "right"))


def _hash(keys: Sequence[str], seed: int, step: str) -> Column:
    return F.xxhash64(F.lit(f"{seed}/{step}"), *keys)
