"""Documents with nearly equal sets of word n-grams: an exact Jaccard join.

A document's set holds the hashes of its distinct n-grams. All sets are put in one order, rare
n-grams first, by a table of counts of one fixed size over the whole corpus. Two sets that reach
the threshold share an n-gram among the first few of each (the prefix), so only prefixes are
joined. Pairs that meet must also agree in length, leave enough n-grams after the place where they
meet (positional filter), and may not be known to differ in too many n-grams. For that each place
gets one parity bit for each of 512 classes of its set's n-grams: two sets differ in at least as
many n-grams as bits. This is the Hamming bound of a suffix filter, taken over the whole set, since
rare-first order leaves what near copies differ in before the suffix. All three are tested as
places meet; where few sets share an n-gram, the first two are tested before, so that parities go
only to places that may be part of a pair. Only then is a pair verified, by its whole texts.

Documents of equal sets are one node. In a large group of near copies, most pairs lie inside one
component after few links are known: a round of pivots compares all that share an n-gram with some
of them only, and the pairs that remain are those between different components.

Links are then counted for themselves. All links of a set are inside its component, so a component
is cut into blocks of sets of like size, and every two blocks whose sizes can link are compared
whole: their overlaps are one product of two 0/1 matrices. Texts go to the blocks, and their sets
are made there: compressed, a text takes little over half of the room of its hashes.
"""

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.arrays import (
    NON_SPACE,
    SMALL_SLICE_BYTES,
    Texts,
    gram_hashes,
    mix,
    runs,
    text_slices,
    word_hashes,
)
from tallybook.llm.components import connected_components
from tallybook.llm.keys import join_counted, maybe_among, without
from tallybook.llm.storage import stored

SKETCH_BITS = 21
CLASS_BITS = 9  # the highest bits of a hash are the class of an n-gram
# How many sets each round draws at every place, to be compared with all others there.
PIVOTS = (16,)
# Places of an n-gram that so few sets share are compared before parities are sent to them.
FEW = 16
# Places of one n-gram are dealt to so many tasks that each has about this many of them.
PLACES = 256
# About so many sets, or n-grams in them, make a block of a component.
BLOCK_SETS = 256
BLOCK_GRAMS = 1 << 20
_PIECE = 1 << 13
_COLUMNS = 1 << 11


def similar_documents(
    docs: DataFrame, words: int, percent: int, count_links: bool = True
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row.

    Texts are lower-cased (A to Z) and cut at white space; the set has all runs of ``words`` words,
    or the whole sequence where there are fewer. Documents are linked where ``100 * intersection >=
    percent * union``; a component's id is the smallest id that links reach. ``n_links`` counts the
    other sets that the document's set is linked with, all of them and each once, however many
    documents have it. It takes all pairs of a component; without ``count_links`` it is left out.

    Null, empty and blank texts have no set and no links, and are their own component. Repeated
    ids, null ids (last among ids) and equal rows are separate rows with the same answer; ties need
    no order. An empty table gives no rows, and other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sketch = spark.sparkContext.broadcast(_sketch(docs, words))
    prefixes = _prefixes(docs, words, percent, sketch)
    rows = stored(prefixes.withColumn("row", F.monotonically_increasing_id()), "prefixes")
    real = rows.where("n > 0")
    # A set goes by the number of the first row that has it.
    sets = stored(
        real.groupBy("s1", "s2", "n").agg(
            F.min("doc_id").alias("first_id"),
            F.count("*").alias("copies"),
            F.min("row").alias("set_id"),
            F.min_by("doc_id", "row").alias("head_id"),
        ),
        "sets",
    )
    total = real.count()
    repeats = stored(
        real.select("row").join(sets.select(F.col("set_id").alias("row")), "row", "left_anti"),
        "repeats",
    )
    # Most rows are surely no repeats, and stay where they are with their prefixes.
    heads = without(real, repeats, ["row"]).select(
        F.col("row").alias("set_id"), "doc_id", "s1", "s2", "n", "prefix", "parity"
    )
    heads = stored(heads, "heads")
    places = heads.select("set_id", "n", F.posexplode("prefix").alias("at", "gram"))
    # A set has an n-gram once, so places are sets.
    meeting = places.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    meeting = stored(meeting, "meeting")
    places = stored(maybe_among(places, meeting, ["gram"], True).join(meeting, "gram"), "places")
    links = _links(docs, words, percent, heads, places)

    roots = connected_components(links)
    labels = sets.join(roots, F.col("set_id") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "set_id")
    )
    first = labels.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answers = labels.join(first, "root").select(
        "set_id", "s1", "s2", "n", "copies", "component_id"
    )
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    if count_links:
        degree = stored(_degrees(docs, words, percent, labels.where("node IS NOT NULL")), "degrees")
        answers = answers.join(degree, "set_id", "left").withColumn(
            "n_links", F.coalesce("n_links", F.lit(0).cast("bigint"))
        )
        columns.append("n_links")
    found = join_counted(real, answers.drop("set_id"), ["s1", "s2", "n"], "copies", total)
    alone = rows.where("n = 0").select(
        "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return found.select(*columns).unionByName(alone.select(*columns))


# --- sets ------------------------------------------------------------------------------------


def _sets(texts: Texts, words: int, seed: int = 0) -> Iterator[np.ndarray]:
    """The n-grams of each text, with repeats, in the order of the text whatever the seed is."""
    starts, ends = runs(texts.data, texts.offsets, NON_SPACE)
    hashes = word_hashes(texts.data, starts, ends, seed)
    cuts = np.searchsorted(starts, texts.offsets)
    grams = gram_hashes(hashes, words)
    for begin, after in zip(cuts[:-1], cuts[1:]):
        if after - begin >= words:
            yield grams[begin : after - words + 1]
        elif after > begin:
            # The whole sequence, told apart from n-grams by its length.
            whole = gram_hashes(hashes[begin:after], after - begin)
            yield mix(whole + np.uint64(after - begin))
        else:
            yield grams[:0]


def _identified(
    texts: Texts, words: int
) -> Iterator[tuple[np.ndarray, tuple[np.uint64, np.uint64]]]:
    """Per text its set, and two sums over it that are made of independent hashes."""
    for grams, others in zip(_sets(texts, words), _sets(texts, words, seed=1)):
        grams, places = np.unique(grams, return_index=True)
        yield grams, (grams.sum(dtype=np.uint64), others[places].sum(dtype=np.uint64))


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Counts of n-grams by the low bits of their hash, over all documents: 8 MB."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int32)
        for batch in batches:
            for texts in text_slices(batch.column("text"), SMALL_SLICE_BYTES):
                grams = np.concatenate([*_sets(texts, words), np.zeros(0, np.uint64)])
                low = (grams & np.uint64(size - 1)).astype(np.int64)
                counts += np.bincount(low, minlength=size).astype(np.int32)
        yield _pieces(range(size // _PIECE), counts.reshape(-1, _PIECE))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist())
            for piece, counts in rows:
                sums.setdefault(piece, np.zeros(_PIECE, np.int64))
                sums[piece] += _counts(counts)
        # Only the order of the counts matters; the greatest ones may be cut to 32 bits.
        yield _pieces(sums, [np.minimum(s, (1 << 31) - 1).astype(np.int32) for s in sums.values()])

    schema = "piece int, counts binary"
    counted = docs.select("text").mapInArrow(count, schema).repartition("piece")
    sketch = np.zeros((size // _PIECE, _PIECE), np.int32)
    for row in counted.mapInArrow(add, schema).collect():  # one fixed size in all
        sketch[row.piece] = _counts(row.counts)
    return sketch.ravel()


def _pieces(pieces, counts) -> pa.RecordBatch:
    """Counts as compressed bytes, the lowest ones of all counts first: most others are zero."""
    packed = [
        pa.compress(c.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
        for c in counts
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(pieces), pa.int32()), pa.array(packed, pa.binary())],
        names=["piece", "counts"],
    )


def _counts(packed: bytes) -> np.ndarray:
    whole = pa.decompress(packed, 4 * _PIECE, codec="zstd", asbytes=True)
    columns = np.frombuffer(whole, np.uint8).reshape(4, _PIECE)
    return np.ascontiguousarray(columns.T).view(np.int32).ravel()


def _prefixes(docs: DataFrame, words: int, percent: int, sketch) -> DataFrame:
    """Per document the size of its set, two sums that identify the set, its prefix, and the
    parities of its classes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for texts in text_slices(batch.column("text"), SMALL_SLICE_BYTES):
                sizes, first, second, prefixes, parities = [], [], [], [], []
                for grams, sums in _identified(texts, words):
                    n = len(grams)
                    kept = n - -(-percent * n // 100) + 1 if n else 0
                    often = counts[(grams & mask).astype(np.int64)]
                    prefixes.append(grams[np.lexsort((grams, often))[:kept]].view(np.int64))
                    classes = (grams >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
                    odd = np.bincount(classes, minlength=1 << CLASS_BITS).astype(np.uint8) & 1
                    parities.append(np.packbits(odd).view(np.int64))
                    sizes.append(n)
                    first.append(sums[0])
                    second.append(sums[1])
                lengths = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate([*prefixes, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(texts.first, len(texts)),
                        pa.array(np.array(sizes, np.int64)),
                        pa.array(np.array(first, np.uint64).view(np.int64)),
                        pa.array(np.array(second, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                        pa.array(parities, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "s1", "s2", "prefix", "parity"],
                )

    return docs.mapInArrow(
        find,
        f"doc_id {id_type}, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, parity array<bigint>",
    )


def _texts(docs: DataFrame, words: int, ids: DataFrame) -> DataFrame:
    """``s1, s2, text`` of the documents whose id is one of ``ids``, and of few others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column("text"), SMALL_SLICE_BYTES):
                sums = np.array([sums for _, sums in _identified(texts, words)], np.uint64)
                first, second = np.ascontiguousarray(sums.reshape(-1, 2).T).view(np.int64)
                text = batch.column("text").slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first), pa.array(second), text], names=["s1", "s2", "text"]
                )

    near = maybe_among(docs, ids, ["doc_id"], True)
    return near.mapInArrow(find, "s1 bigint, s2 bigint, text string")


# --- links -----------------------------------------------------------------------------------


def _links(
    docs: DataFrame, words: int, percent: int, heads: DataFrame, places: DataFrame
) -> DataFrame:
    """Links ``a < b`` between sets, enough to connect whatever any link connects."""
    labels = verified = None
    for number, pivots in enumerate([*PIVOTS, None]):
        labelled = places.withColumn("root", F.col("set_id"))
        if labels is not None:
            labelled = (
                places.join(labels, F.col("set_id") == F.col("node"), "left")
                .withColumn("root", F.coalesce("root", "set_id"))
                .drop("node")
            )
        # Pivots save nothing where there are hardly more sets than pivots.
        least = 1 if pivots is None else max(PIVOTS)
        labelled = stored(_undecided(labelled, least, percent), "undecided")
        if pivots is None:
            # Parities are eight times as wide as the rest of a place: they join it last.
            parities = heads.select("set_id", "parity")
            pairs = _all_pairs(labelled.join(parities, "set_id"), percent)
        else:
            pairs = _pivot_pairs(labelled, percent, number, pivots)
        pairs = pairs.distinct()
        if verified is not None:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        pairs = stored(_identified_pairs(pairs, heads, percent), "pairs")
        wanted = pairs.select(F.explode(F.array("a_id", "b_id")).alias("doc_id")).distinct()
        texts = stored(_texts(docs, words, wanted), "texts")
        checked = stored(_verified(pairs, texts, words, percent).distinct(), "verified")
        verified = checked if verified is None else verified.unionByName(checked)
        links = verified.where("linked").select("a", "b")
        if pivots is not None:
            labels = connected_components(links)
    return links


def _undecided(labelled: DataFrame, least: int, percent: int) -> DataFrame:
    """Places where sets of several components meet, more than ``least`` sets in all, with the
    largest of those components and the number of tasks they are dealt to.

    Where at most ``FEW`` sets meet, only places are left that pass the length and positional
    filters with another one.
    """
    labelled = labelled.where(F.col("held") > least)
    few = labelled.where(F.col("held") <= FEW).groupBy("gram").agg(
        F.collect_list(F.struct(*_OF_SET)).alias("places")
    )
    few = (
        few.withColumn(
            "places",
            F.filter("places", lambda x: F.exists("places", lambda y: _may_reach(x, y, percent))),
        )
        .withColumn("main", F.array_max(F.transform("places", lambda x: x["root"])))
        .selectExpr("gram", "main", "1 AS parts", "inline(places)")
    )
    many = labelled.where(F.col("held") > FEW)
    by_root = many.groupBy("gram", "root").agg(F.count("*").alias("size"))
    by_gram = (
        by_root.groupBy("gram")
        .agg(F.max_by("root", "size").alias("main"), F.count("*").alias("roots"))
        .where("roots > 1")
        .select("gram", "main")
    )
    parts = F.ceil(F.col("held") / PLACES).cast("int").alias("parts")
    columns = "gram", *_OF_SET, "main"
    many = many.join(by_gram, "gram").select(*columns, parts)
    return few.select(*columns, "parts").unionByName(many)


def _all_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs across components; at least one of each is outside its place's main component."""
    columns = *_OF_SET, "parity"
    x = labelled.where("root <> main").select(
        "gram", "parts", *[F.col(c).alias(f"x_{c}") for c in columns]
    )
    return _filtered(_met(x, labelled, columns), percent, True)


def _met(x: DataFrame, labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each of ``x`` with ``columns`` of all places of its n-gram, which are dealt to several parts
    where they are many; ``x`` goes to all of them."""
    part = F.expr("int(pmod(xxhash64(set_id), parts))").alias("part")
    y = labelled.select("gram", part, *[F.col(c).alias(f"y_{c}") for c in columns])
    x = x.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    return y.join(x, ["gram", "part"])


def _pivot_pairs(labelled: DataFrame, percent: int, number: int, pivots: int) -> DataFrame:
    """At each place, some sets drawn at random (the same at every place, if they are there)
    against all."""
    chosen = [
        F.min_by(column, F.xxhash64("set_id", F.lit(f"{number}/{k}"))).alias(f"{column}_{k}")
        for k in range(pivots)
        for column in _OF_SET
    ]
    structs = ", ".join(
        "struct(" + ", ".join(f"{c}_{k} AS x_{c}" for c in _OF_SET) + ")" for k in range(pivots)
    )
    x = (
        labelled.groupBy("gram", "parts")
        .agg(*chosen)
        .selectExpr("gram", "parts", f"inline(array({structs}))")
    )
    return _filtered(_met(x.distinct(), labelled, _OF_SET), percent, False)


_OF_SET = "set_id", "n", "at", "root"


def _filtered(met: DataFrame, percent: int, parities: bool) -> DataFrame:
    """Length and positional filter, and the bound by parities where both sides have them."""
    x, y = ({c: F.col(f"{side}_{c}") for c in _OF_SET} for side in "xy")
    met = met.where(_may_reach(x, y, percent))
    if parities:
        met = met.where(_may_agree("x", "y", percent))
    return met.select(
        F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b")
    )


def _may_reach(
    x: Mapping[str, Column] | Column, y: Mapping[str, Column] | Column, percent: int
) -> Column:
    """Whether places of two components pass the length and positional filters."""
    after = F.least(x["n"] - x["at"], y["n"] - y["at"])
    return (
        (x["root"] != y["root"])
        & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
        & (after >= _needed(x["n"], y["n"], percent))
    )


def _may_agree(x: str, y: str, percent: int) -> Column:
    """Whether the parities leave enough overlap: a class of unlike parity has an n-gram that only
    one of the sets has."""
    x_n, y_n = F.col(f"{x}_n"), F.col(f"{y}_n")
    apart = F.expr(
        f"aggregate(zip_with({x}_parity, {y}_parity, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    )
    return x_n + y_n - apart >= 2 * _needed(x_n, y_n, percent)


def _identified_pairs(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parities leave enough overlap, with document and sums of both sets."""
    for x in ("a", "b"):
        of_x = heads.selectExpr(
            f"set_id AS {x}", f"doc_id AS {x}_id", f"s1 AS {x}_1", f"s2 AS {x}_2",
            f"n AS {x}_n", f"parity AS {x}_parity",
        )
        pairs = pairs.join(of_x, x)
    return pairs.where(_may_agree("a", "b", percent)).select(
        "a", "b", "a_id", "b_id", "a_1", "a_2", "b_1", "b_2"
    )


def _needed(x: Column, y: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that reaches the threshold."""
    return F.ceil(percent * (x + y) / F.lit(100 + percent))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Whether each pair is linked, by the intersection of the sets of the whole texts."""

    def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
        for texts in text_slices(column, SMALL_SLICE_BYTES):
            yield from map(np.unique, _sets(texts, words))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(sets_of(batch.column("a_text")), sets_of(batch.column("b_text"))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
                names=["a", "b", "linked"],
            )

    one, two = (
        texts.selectExpr(f"s1 AS {x}_1", f"s2 AS {x}_2", f"text AS {x}_text") for x in ("a", "b")
    )
    whole = pairs.drop("a_id", "b_id").join(one, ["a_1", "a_2"]).join(two, ["b_1", "b_2"])
    return whole.select("a", "b", "a_text", "b_text").mapInArrow(
        verify, "a bigint, b bigint, linked boolean"
    )


# --- number of links -------------------------------------------------------------------------


def _degrees(docs: DataFrame, words: int, percent: int, labels: DataFrame) -> DataFrame:
    """``set_id, n_links``: with how many sets of its component each set is linked."""
    # Sizes that can link are in one band or in neighbouring ones; a little wider, for rounding.
    width = 1.001 * max(math.log(100 / percent), 1e-3)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int").alias("band")
    members = stored(labels.select("set_id", "head_id", "s1", "s2", "n", "root", band), "linked")
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS))
    layouts = (
        members.groupBy("root", "band")
        .agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
        .groupBy("root")
        .agg(
            F.sum("sets").alias("copies"),
            F.sum("grams").alias("grams"),
            F.map_from_entries(F.collect_list(F.struct("band", blocks.cast("int")))).alias("blocks"),
        )
        .withColumn("whole", (F.col("copies") <= BLOCK_SETS) & (F.col("grams") <= BLOCK_GRAMS))
    )
    layouts = stored(layouts.drop("grams"), "layouts")
    placed = join_counted(members, layouts, "root", "copies", members.count())
    placed = placed.withColumn(
        "mine", F.expr("int(pmod(xxhash64(set_id), element_at(blocks, band)))")
    ).withColumn("jobs", F.expr(_JOBS))
    texts = _texts(docs, words, members.select(F.col("head_id").alias("doc_id")))
    compared = (
        texts.join(placed.select("set_id", "root", "s1", "s2", "jobs"), ["s1", "s2"])
        .select("set_id", "root", "text", F.explode("jobs").alias("job"))
        .select("set_id", "root", "text", "job.*")
    )
    counted = compared.groupBy("root", "x_band", "x", "y_band", "y").applyInArrow(
        _block_links(words, percent), "set_id bigint, links bigint"
    )
    return counted.groupBy("set_id").agg(F.sum("links").alias("n_links"))


# The pairs of blocks that a set takes part in, and on which sides.
_JOB = "named_struct('x_band', {}, 'x', {}, 'y_band', {}, 'y', {}, 'in_x', {}, 'in_y', {})"
_OTHERS = "transform(sequence(0, coalesce(element_at(blocks, {}), 1) - 1), q -> {})"
_SAME_BAND = _OTHERS.format(
    "band", _JOB.format("band", "least(mine, q)", "band", "greatest(mine, q)", "mine <= q", "mine >= q")
)
_NEXT_BAND = _OTHERS.format(
    "band + 1", _JOB.format("band", "mine", "band + 1", "q", "true", "false")
)
_LAST_BAND = _OTHERS.format(
    "band - 1", _JOB.format("band - 1", "q", "band", "mine", "false", "true")
)
_JOBS = f"""if(whole, array({_JOB.format(0, 0, 0, 0, "true", "true")}), concat({_SAME_BAND},
    if(map_contains_key(blocks, band + 1), {_NEXT_BAND}, array()),
    if(map_contains_key(blocks, band - 1), {_LAST_BAND}, array())))"""


def _block_links(words: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    def count(table: pa.Table) -> pa.Table:
        # Rows that repeat a document's id bring its set again.
        ids, rows = np.unique(table.column("set_id").to_numpy(), return_index=True)
        table = table.take(pa.array(rows))
        column = table.column("text").combine_chunks()
        sets = [np.unique(s) for texts in text_slices(column) for s in _sets(texts, words)]
        x, y = (np.flatnonzero(table.column(c).to_numpy()) for c in ("in_x", "in_y"))
        sizes = np.array([len(s) for s in sets], np.int64)
        common = _overlaps(sets, sizes, x, y)
        linked = 100 * common >= percent * (sizes[x][:, None] + sizes[y] - common)
        linked &= ids[x][:, None] != ids[y]
        links = np.zeros(len(ids), np.int64)
        links[x] += linked.sum(axis=1)
        alone = ~np.isin(y, x)  # a block against itself has both directions in its rows
        links[y[alone]] += linked.sum(axis=0)[alone]
        return pa.table({"set_id": ids, "links": links})

    return count


def _overlaps(sets: list[np.ndarray], sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets ``x`` with the sets ``y``."""
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    several = held > 1
    kept = several[column]
    row, column = row[kept], (np.cumsum(several) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(x), len(y)), np.int64)
    for begin in range(0, int(several.sum()), _COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + _COLUMNS])
        holds = np.zeros((len(sets), _COLUMNS), np.float32)
        holds[row[low:high], column[low:high] - begin] = 1
        common += (holds[x] @ holds[y].T).astype(np.int64)
    return common
