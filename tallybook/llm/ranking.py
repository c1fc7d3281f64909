"""Ranked search of all documents for many items, by pipelined term partitioning.

Every term of the items has one owner, by how many documents hold it. Items travel in bundles from
owner to owner, rare terms first. A bundle carries for each item the documents it has met and their
scores so far, sparsely; a stage is a cogroup of the bundles with the owner's postings, which adds
the weights of the owner's terms. After the last owner the best documents of each item are chosen.

Documents are read in blocks, and bundles travel per block: neither the postings of a term nor the
documents of an item ever come together in one task, however frequent a term is.

A bundle leaves out a document as soon as it cannot be among the best of its block any more: the
terms that are still to come give it less than it lacks. That never changes a result.
"""

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tallybook.llm.storage import stored

BEST = 10
BLOCK_DOCS = 4096
BUNDLE_ITEMS = 256
# A dictionary of terms that is broadcast; with more terms the documents are read once for each.
DICTIONARY_TERMS = 1 << 18
DICTIONARY_BYTES = 1 << 25
# Items' terms of about 40 bytes; with more of them bundles are joined instead of broadcast.
BROADCAST_TERMS, SALTS = 400_000, 64
# Owners by the share of documents that hold a term: below the first, below the second, ...
OWNERS = (1 / 64, 1 / 16, 1 / 4)
# The parts of a score.
SCALE, SATURATION, PER_LENGTH = 1_000_000_000, 1000, 8
LENGTH_BASE, LENGTH_SLOPE = 100, 90
# What a term can add, times its weight.
_MOST = SCALE // SATURATION

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_CHUNK = 1 << 20

_BLOCKS = """block bigint, docs binary, ids {ids}, n_docs bigint, n_terms bigint,
    held array<struct<term: int, df: bigint>>, postings binary"""


def rank(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    block_docs: int = BLOCK_DOCS,
    bundle_items: int = BUNDLE_ITEMS,
    dictionary_terms: int = DICTIONARY_TERMS,
) -> DataFrame:
    """Per row of ``items`` its ``best`` documents: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all characters above U+007F, A-Z in lower
    case; null and empty texts have none. Scores above 0 only; equal ones go by ``doc_id``, null
    first. Every row counts as a document, and as an item, of its own, whatever its id; repeated
    rows have equal scores and successive ranks. Texts are read whole, long ones in slices. No
    documents or no items give no rows. Other columns are not read. Documents must come in the same
    order when they are read again, as those of a stored table do.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # One row for each item and term.
    wanted = stored(
        items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_item", F.monotonically_increasing_id())
        .mapInArrow(
            _terms_of_items, _fields(items.select("item_id"), "_item bigint, term binary")
        ),
        "rank-items",
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_terms, n_bytes = (
        wanted.select("term")
        .distinct()
        .agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)))
        .first()
    )
    # A term longer than half of a dictionary's bytes is still in one of its own.
    parts = max(-(-n_terms // dictionary_terms), -(-n_bytes // DICTIONARY_BYTES), 1)
    numbered = wanted.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))

    read, names = [], []
    for part in range(parts):
        terms = [
            row[0] for row in numbered.where(F.col("_part") == part).select("term").distinct()
            .sort("term").collect()
        ]
        dictionary = docs.sparkSession.sparkContext.broadcast(
            {bytes(term): i for i, term in enumerate(terms)}
        )
        blocks = texts.mapInArrow(
            lambda batches, known=dictionary: _read_blocks(batches, known, block_docs),
            _BLOCKS.format(ids=f"array<{id_type}>"),
        ).withColumn("_part", F.lit(part))
        read.append(stored(blocks, "rank-blocks"))
        frame = docs.sparkSession.createDataFrame(
            [(part, i, term) for i, term in enumerate(terms)], "_part int, _term int, term binary"
        )
        names.append(frame)
    blocks, known = read[0], names[0]
    for more, name in zip(read[1:], names[1:]):
        blocks, known = blocks.unionByName(more), known.unionByName(name)

    # Documents are counted once, whatever the number of dictionaries.
    n_docs, all_terms = (
        read[0].agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)))
        .first()
    )
    held = (
        blocks.select("_part", F.inline("held"))
        .groupBy("_part", F.col("term").alias("_term"))
        .agg(F.sum("df").alias("df"))
    )
    owner = F.lit(len(OWNERS))
    for number in reversed(range(len(OWNERS))):
        owner = F.when(F.col("df") < OWNERS[number] * n_docs, number).otherwise(owner)
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighted = stored(
        held.join(known, ["_part", "_term"]).select(
            "term", "_part", "_term", owner.alias("_owner"), weight.cast("bigint").alias("_weight")
        ),
        "rank-terms",
    )
    n_bundles = max(-(-wanted.select("_item").distinct().count() // bundle_items), 1)
    bundles = _bundles(wanted.join(weighted, "term"), n_bundles)
    found = _through_the_owners(
        bundles, n_bundles, blocks, weighted, all_terms, n_docs, best, parts
    )
    place = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= best)
        .select("item_id", "rank", "doc_id", "score")
    )


def _bundles(wanted: DataFrame, n_bundles: int) -> DataFrame:
    """Bundles of items: the terms of each with owner and weight, and the items' ids."""
    term = F.struct("_item", "_owner", "_part", "_term", "_weight")
    return stored(
        wanted.withColumn("_bundle", F.pmod(F.xxhash64("_item"), F.lit(n_bundles)).cast("int"))
        .groupBy("_bundle")
        .agg(
            F.collect_list(term).alias("_terms"),
            F.collect_set(F.struct("_item", "item_id")).alias("_items"),
        ),
        "rank-bundles",
    )


def _through_the_owners(
    bundles: DataFrame,
    n_bundles: int,
    blocks: DataFrame,
    weighted: DataFrame,
    all_terms: int,
    n_docs: int,
    best: int,
    parts: int,
) -> DataFrame:
    """The best documents of each item in each block: ``_item, item_id, doc_id, score``."""
    spark = blocks.sparkSession
    # Two small numbers for each term, and no more terms in a part than a dictionary holds.
    owners = [
        spark.sparkContext.broadcast(
            _owner_array(weighted.where(F.col("_part") == part).select("_term", "_owner").collect())
        )
        for part in range(parts)
    ]
    n_owners = len(OWNERS) + 1
    state = StructType(
        [
            StructField("_block", LongType()),
            *bundles.schema.fields,
            *[StructField(c, BinaryType()) for c in ("_hits", "_scores")],
        ]
    )
    ids = StructField("ids", blocks.schema["ids"].dataType)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("_bundle")
    # Each bundle sets out once for each block.
    starts = blocks.where("_part = 0").select(F.col("block").alias("_block"), every)
    if (bundles.agg(F.sum(F.size("_terms"))).first()[0] or 0) <= BROADCAST_TERMS:
        starts = starts.join(F.broadcast(bundles), "_bundle")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        starts = starts.withColumn("_salt", F.pmod("_block", F.lit(SALTS)).cast("int")).join(
            bundles.withColumn("_salt", salt), ["_bundle", "_salt"]
        )
    nothing = F.lit(b"")
    travelling = starts.select(
        "_block", *bundles.columns, nothing.alias("_hits"), nothing.alias("_scores")
    )
    out = StructType(
        [
            StructField("_item", LongType()),
            bundles.schema["_items"].dataType.elementType["item_id"],
            StructField("doc_id", ids.dataType.elementType),
            StructField("score", LongType()),
        ]
    )
    postings = StructType(
        [
            StructField("_block", LongType()),
            StructField("_part", IntegerType()),
            ids,
            StructField("postings", BinaryType()),
        ]
    )
    for stage in range(n_owners):
        last = stage == n_owners - 1
        owned = blocks.select("block", "_part", "docs", "ids", "postings").mapInArrow(
            lambda batches, stage=stage, last=last: _owned(
                batches, owners, stage, all_terms, n_docs, last
            ),
            postings,
        )
        owned = owned.select("*", every)
        travelling = (
            travelling.groupBy("_block", "_bundle")
            .cogroup(owned.groupBy("_block", "_bundle"))
            .applyInArrow(_visitor(stage, best, state, out, last), out if last else state)
        )
        if not last:
            travelling = stored(travelling, f"rank-stage-{stage}")
    return travelling


def _owner_array(rows) -> np.ndarray:
    owner = np.full(max((row[0] for row in rows), default=-1) + 1, -1, np.int8)
    for row in rows:
        owner[row[0]] = row[1]
    return owner


def _fields(frame: DataFrame, more: str) -> StructType:
    return StructType(frame.schema.fields + StructType.fromDDL(more).fields)


def count_terms(text: bytes) -> Counter:
    """How often each term occurs, a long text in slices that end between two terms."""
    text = text.lower()  # A-Z only
    if len(text) <= _CHUNK:
        return Counter(_TERM.findall(text))
    counts, at = Counter(), 0
    while at < len(text):
        gap = _BETWEEN.search(text, at + _CHUNK)
        end = gap.start() if gap else len(text)
        counts.update(_TERM.findall(text, at, end))
        at = end
    return counts


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _terms_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(_binary(batch.column("text"))):
            terms = list(count_terms(text))
            same = pa.array([i] * len(terms), pa.int64())
            yield pa.record_batch(
                [
                    batch.column("item_id").take(same),
                    batch.column("_item").take(same),
                    pa.array(terms, pa.binary()),
                ],
                ["item_id", "_item", "term"],
            )


def _read_blocks(
    batches: Iterator[pa.RecordBatch], dictionary, block_docs: int
) -> Iterator[pa.RecordBatch]:
    """Blocks of successive documents: ids, lengths, and the postings of known terms by term."""
    known = dictionary.value
    block = TaskContext.get().partitionId() << 33
    ids, lengths, docs, terms, counts = [], [], [], [], []

    def flush() -> pa.RecordBatch:
        nonlocal block
        posting = np.array([terms, docs, counts], np.int64)
        posting = posting[:, np.argsort(posting[0], kind="stable")]
        held, df = np.unique(posting[0], return_counts=True)
        n = np.array(lengths, np.int64)
        held = pa.StructArray.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(df.astype(np.int64))], ["term", "df"]
        )
        row = [
            pa.array([block], pa.int64()),
            pa.array([n.tobytes()], pa.binary()),
            pa.ListArray.from_arrays([0, len(n)], pa.concat_arrays(ids)),
            pa.array([int((n > 0).sum())], pa.int64()),
            pa.array([int(n.sum())], pa.int64()),
            pa.ListArray.from_arrays([0, len(held)], held),
            pa.array([posting.tobytes()], pa.binary()),
        ]
        block += 1
        for values in (ids, lengths, docs, terms, counts):
            values.clear()
        return pa.record_batch(
            row, ["block", "docs", "ids", "n_docs", "n_terms", "held", "postings"]
        )

    for batch in batches:
        for i in range(len(batch)):
            found = count_terms(batch.column("text")[i].as_py().encode())
            for term, count in found.items():
                number = known.get(term)
                if number is not None:
                    terms.append(number)
                    docs.append(len(lengths))
                    counts.append(count)
            ids.append(batch.column("doc_id").slice(i, 1))
            lengths.append(sum(found.values()))
            if len(lengths) == block_docs:
                yield flush()
    if lengths:
        yield flush()


def _owned(
    batches: Iterator[pa.RecordBatch],
    owners: list,
    stage: int,
    all_terms: int,
    n_docs: int,
    last: bool,
) -> Iterator[pa.RecordBatch]:
    """The owner's part of each block's postings, with what one unit of weight adds."""
    for batch in batches:
        for i in range(len(batch)):
            part = batch.column("_part")[i].as_py()
            n = np.frombuffer(batch.column("docs")[i].as_py(), np.int64)
            term, doc, tf = np.frombuffer(
                batch.column("postings")[i].as_py(), np.int64
            ).reshape(3, -1)
            own = owners[part].value[term] == stage
            term, doc, tf = term[own], doc[own], tf[own]
            length = (LENGTH_SLOPE * n[doc] * n_docs) // max(all_terms, 1)
            length += LENGTH_BASE - LENGTH_SLOPE
            unit = (SCALE * tf) // (SATURATION * tf + PER_LENGTH * length)
            ids = batch.column("ids").slice(i, 1)
            if not last or part:  # only the last stage asks for the ids
                ids = pa.nulls(1, ids.type)
            yield pa.record_batch(
                [
                    batch.column("block").slice(i, 1),
                    batch.column("_part").slice(i, 1),
                    ids,
                    pa.array([np.array([term, doc, unit], np.int32).tobytes()], pa.binary()),
                ],
                ["_block", "_part", "ids", "postings"],
            )


def _visitor(
    stage: int, best: int, state: StructType, out: StructType, last: bool
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    empty = to_arrow_schema(out if last else state).empty_table()

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a bundle that no item has fallen into
            return empty
        return _visit(left, right, stage, best, last)

    return visit


def _visit(left: pa.Table, right: pa.Table, stage: int, best: int, last: bool) -> pa.Table:
    """Add what the owner's postings give to a bundle's documents of one block."""
    (bundle,) = left.to_pylist()
    row_of = {item["_item"]: i for i, item in enumerate(bundle["_items"])}
    hits = np.frombuffer(bundle["_hits"], np.int32).reshape(2, -1)
    parts = {}
    n = int(hits[1].max()) + 1 if hits.size else 0
    for part, data in zip(right.column("_part").to_pylist(), right.column("postings").to_pylist()):
        parts[part] = np.frombuffer(data, np.int32).reshape(3, -1)
        if parts[part].size:
            n = max(n, int(parts[part][1].max()) + 1)
    scores = np.zeros((len(row_of), n), np.int64)
    scores[hits[0], hits[1]] = np.frombuffer(bundle["_scores"], np.int64)
    to_come = np.zeros(len(row_of), np.int64)
    for term in bundle["_terms"]:
        row = row_of[term["_item"]]
        if term["_owner"] > stage:
            to_come[row] += term["_weight"] * _MOST
        elif term["_owner"] == stage:
            numbers, docs, units = parts[term["_part"]]
            a, b = np.searchsorted(numbers, (term["_term"], term["_term"] + 1))
            # A document occurs once among the postings of a term.
            scores[row, docs[a:b]] += units[a:b].astype(np.int64) * term["_weight"]
    if last:
        return _best_of_block(row_of, left, scores, right, best)
    if n > best:
        least = np.partition(scores, n - best, axis=1)[:, n - best]
        keep = (scores > 0) & (scores + to_come[:, None] >= least[:, None])
    else:
        keep = scores > 0
    item, doc = np.nonzero(keep)
    packed = np.array([item, doc], np.int32).tobytes()
    moved = left.drop_columns(["_hits", "_scores"])
    return moved.append_column("_hits", pa.array([packed], pa.binary())).append_column(
        "_scores", pa.array([scores[item, doc].tobytes()], pa.binary())
    )


def _best_of_block(
    row_of: dict[int, int], left: pa.Table, scores: np.ndarray, right: pa.Table, best: int
) -> pa.Table:
    column = right.column("ids").combine_chunks()
    (ids,) = [column[i].values for i in range(len(column)) if column[i].is_valid]
    # Documents in the order of their ids, null first, and the place of each there.
    order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    items = left.column("_items").combine_chunks().flatten()
    rows, docs, points = [], [], []
    for number, item in enumerate(items.field("_item").to_pylist()):
        mine = scores[row_of[item]]
        found = np.flatnonzero(mine)
        chosen = found[np.lexsort((place[found], -mine[found]))[:best]]
        rows += [number] * len(chosen)
        docs += chosen.tolist()
        points += mine[chosen].tolist()
    rows, docs = pa.array(rows, pa.int64()), pa.array(docs, pa.int64())
    return pa.table(
        {
            "_item": items.field("_item").take(rows),
            "item_id": items.field("item_id").take(rows),
            "doc_id": ids.take(docs),
            "score": pa.array(points, pa.int64()),
        }
    )
