"""A hash tree over the rows of a table, with the proof of every row.

Rows fall into groups. The leaves of a group are numbered in order; as long as there are several
nodes, every ``fanout`` consecutive ones become one, the hash of their digests. What remains is
the group's subroot, and the subroots, in the order of their groups, make the root in the same way.

A level is a slot pivot: conditional aggregates over the children of a parent spread them into
``fanout`` columns. All columns together are hashed to the parent; all but the own one are the
siblings, which make up the proof.

Leaves are dealt out in blocks of ``fanout ** LEVELS`` consecutive ones, so that one exchange serves
``LEVELS`` levels, and only one row for each block goes on to the levels above. So a group with most
of the rows is as many blocks as any other rows would be.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.storage import stored

FANOUT = 2
LEVELS = 8
# Rows of a task; with the proof of its block a row has one or two kilobytes.
TASK_ROWS = 1 << 15

_PATH = "array<struct<before: string, after: string>>"
_NODE = ("_group", "_at", "_count", "_node")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, or ``-`` if it is null; no two values look alike."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by its proof."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def siblings(proof: Column) -> Column:
    """The digests of a proof, from the leaf's siblings up, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(
    rows: DataFrame, leaf: str, group: str, order: str, keep: Sequence[str], fanout: int = FANOUT
) -> DataFrame:
    """The ``keep`` columns of every row, its ``leaf``, ``subroot``, ``root`` and ``proof``.

    The proof has one entry per level: the digests ``before`` and ``after`` the own node.
    Leaves of a group go by ``order``, null first, equal ones by leaf; equal leaves are
    interchangeable, so repeated rows are leaves of their own, and the tree does not depend on how
    rows were dealt out. Groups (text) go by their UTF-8 bytes, null first and apart from an empty
    text. The length of what the leaves were made of plays no part. No rows give no rows, one row
    is leaf, subroot and root at once, with an empty proof. Other columns are not read, whatever
    they are called. Leaves must not be null.
    """
    if fanout < 2:
        raise ValueError(f"a parent needs at least two children: {fanout}")
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(
        named.alias("_group"),
        F.col(order).alias("_order"),
        F.col(leaf).alias("_node"),
        F.struct(F.lit(True).alias("_any"), *keep).alias("_row"),
    )
    climbed = _climb(_numbered(leaves), fanout, lambda roots: _to_the_root(roots, fanout))
    kept = [F.col("_row")[c].alias(c) for c in keep]
    return climbed.select(*kept, F.col("_leaf").alias(leaf), "subroot", "root", "proof")


def _to_the_root(subroots: DataFrame, fanout: int) -> DataFrame:
    """One row for each group: its subroot, and how it goes on to the root."""
    subroots = subroots.withColumn("subroot", F.col("_node"))
    tops = subroots.select(
        F.lit("").alias("_group"),
        F.col("_group").alias("_order"),
        "_node",
        F.struct("_group").alias("_row"),
    )
    none = F.array().cast(_PATH)
    climbed = _climb(
        _numbered(tops),
        fanout,
        lambda top: top.withColumns({"subroot": F.col("_node"), "root": F.col("_node"), "proof": none}),
    )
    found = climbed.select(F.col("_row._group").alias("_group"), "root", "proof")
    return subroots.join(found, "_group")


def _numbered(leaves: DataFrame) -> DataFrame:
    """Add ``_at``, the place in the group, and ``_count``, the size of the group.

    Ranges of the whole order go to tasks; the places of a group in a task are moved behind those
    that it has in earlier tasks. Equal leaves are told apart by where they were read, so that many
    of them do not meet in one task.
    """
    order = ["_group", "_order", "_node", "_tie"]
    dealt = stored(
        stored(leaves, "merkle-leaves")
        .withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_order", "_tie")
        .withColumns(
            {
                "_task": F.spark_partition_id(),
                "_line": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        ),
        "merkle-order",
    )
    # One row per task and group in it: a row for each group and one more for each task.
    parts = dealt.groupBy("_group", "_task").agg(
        F.min("_line").alias("_first"), F.count("*").alias("_rows")
    )
    group = Window.partitionBy("_group")
    ahead = group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_group",
        "_task",
        (F.coalesce(F.sum("_rows").over(ahead), F.lit(0)) - F.col("_first")).alias("_moved"),
        F.sum("_rows").over(group).alias("_count"),
    )
    return (
        dealt.join(parts, ["_group", "_task"])
        .withColumn("_at", F.col("_line") + F.col("_moved"))
        .select(*_NODE, "_row")
    )


def _climb(
    nodes: DataFrame, fanout: int, finish: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Add ``_leaf``, ``subroot``, ``root`` and ``proof`` to every node.

    ``finish`` takes one node for each group and adds the last three.
    """
    nodes = stored(nodes.withColumn("_leaf", F.col("_node")), "merkle-nodes")
    largest, total = nodes.agg(F.max("_count"), F.count("*")).first()
    if (largest or 0) <= 1:
        return finish(nodes)
    block = fanout**LEVELS
    climbed = (
        nodes.withColumns({"_block": _div("_at", block), "_path": F.array().cast(_PATH)})
        # All levels below are grouped by these two and a third column: no more exchange.
        .repartition(-(-total // TASK_ROWS), "_group", "_block")
    )
    for level in range(LEVELS):
        climbed = _level(climbed, fanout, fanout**level)
    climbed = stored(climbed, "merkle-blocks")
    tops = climbed.where(f"_at % {block} = 0").select(
        "_group",
        F.col("_block").alias("_at"),
        _ceil_div("_count", block).alias("_count"),
        "_node",
    )
    above = _climb(tops, fanout, finish).select(
        "_group", F.col("_at").alias("_block"), "subroot", "root", "proof"
    )
    return climbed.join(above, ["_group", "_block"]).withColumn("proof", F.concat("_path", "proof"))


def _level(nodes: DataFrame, fanout: int, width: int) -> DataFrame:
    """Put the parent in the place of the node, ``width`` leaves below each node, and add to the path.

    Where a group has one node left, that node stays.
    """
    slots = [f"_slot{s}" for s in range(fanout)]
    family = Window.partitionBy("_group", "_block", "_parent")
    spread = nodes.withColumns(
        {"_parent": _div("_at", width * fanout), "_own": _div("_at", width) % fanout}
    ).withColumns(
        {slot: F.max(F.when(F.col("_own") == s, F.col("_node"))).over(family)
         for s, slot in enumerate(slots)}
    )
    several = _ceil_div("_count", width) > 1
    # concat_ws passes over the slots that the last family of a level does not fill.
    parent = F.sha2(F.concat_ws("", *slots).cast("binary"), 256)
    before = F.concat_ws("", *[F.when(F.col("_own") > s, F.col(c)) for s, c in enumerate(slots)])
    after = F.concat_ws("", *[F.when(F.col("_own") < s, F.col(c)) for s, c in enumerate(slots)])
    step = F.array(F.struct(before.alias("before"), after.alias("after")))
    return spread.withColumns(
        {
            "_node": F.when(several, parent).otherwise(F.col("_node")),
            "_path": F.when(several, F.concat("_path", step)).otherwise(F.col("_path")),
        }
    ).drop("_parent", "_own", *slots)


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}")


def _ceil_div(column: str, by: int) -> Column:
    return F.expr(f"({column} + {by - 1}) div {by}")
