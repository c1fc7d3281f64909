"""Connected components of a graph of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.storage import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of all linked nodes.

    ``links`` has two bigint columns ``a`` and ``b``. Stars are contracted, large and small by
    turns, until every node hangs on its root; a logarithmic number of rounds, each written out.
    A node with very many links is reduced to its smallest one before the shuffle.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    while not _are_stars(links):
        links = stored(_small_star(_large_star(links)), "stars")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether each greater node has one smaller node, which has none itself."""
    lower = F.when(F.col("a") > F.col("b"), 1).otherwise(2).alias("lower")
    ends = links.select(F.col("a").alias("node"), lower, F.lit(0).alias("upper")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("lower"), F.lit(1).alias("upper"))
    )
    found = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper"))
    return found.where((F.col("lower") > 1) | ((F.col("lower") > 0) & (F.col("upper") > 0))).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Greater neighbours of a node are linked with its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(moved.select("a", F.col("least").alias("b")))
        .where("a <> b")
        .distinct()
    )
