"""Passages of a benchmark inside documents, by winnowing.

Of every ``WINDOW`` consecutive words, the smallest hash among the ``GRAM``-word runs inside is a
fingerprint. Equal windows have equal fingerprints, so a document that holds a window of an item
shares a fingerprint with it at that place: no shared window is missed. Matching fingerprints are
joined, and each match is extended word by word; it counts if ``WINDOW`` words are shared. Items
with fewer words are one window; for them every run of that many words is a fingerprint.

Documents only pass on fingerprints whose bit is set in a bitmap of the items' fingerprints, which
has a fixed size whatever the items are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.arrays import (
    ALPHANUMERIC,
    SMALL_SLICE_BYTES,
    Texts,
    gram_hashes,
    mix,
    runs,
    text_slices,
    word_hashes,
)
from tallybook.llm.storage import stored

WINDOW = 10
GRAM = 5
BITMAP_BITS = 1 << 24
# Rows of about 200 bytes: 20 MB at most are broadcast.
BROADCAST_ROWS = 100_000
SALTS = 32

_REACH = WINDOW - GRAM
_CONTEXT = GRAM + 2 * _REACH
_PRINT = pa.struct(
    [("print", pa.int64()), ("size", pa.int32()), ("at", pa.int64()), ("words", pa.binary())]
)
_PRINTS = "array<struct<print: bigint, size: int, at: bigint, words: binary>>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, items``: its words, how many of them lie in windows
    of items, and the sorted ids of those items.

    Words are runs of ASCII letters and digits and of all other characters over U+007F, A-Z in
    lower case. Null and empty texts have no words; items without words have no windows. Repeated
    rows are answered each, whatever their id; an empty table of documents gives no rows, an empty
    benchmark no hits. Columns other than ids and texts are not read.
    """
    spark = docs.sparkSession
    items = stored(
        _fingerprints(benchmark, "item_id", None, None)
        .select("item_id", F.inline("prints"))
        .distinct(),
        "item-prints",
    )
    lengths = sorted(r["size"] for r in items.select("size").distinct().collect())  # ten at most
    bits = (
        items.selectExpr(
            f"shiftright(print & {BITMAP_BITS - 1}, 6) AS word",
            "shiftleft(1L, int(print & 63)) AS bit",
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()  # BITMAP_BITS / 64 rows at most
    )
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    for row in bits:
        bitmap[row["word"]] = np.uint64(row["bits"] & (1 << 64) - 1)
    shared = spark.sparkContext.broadcast((bitmap, [n for n in lengths if n < WINDOW]))

    found = _fingerprints(docs, "doc_id", shared, "n_words")
    # Rows are told apart by a number that is fixed by writing it, ids may be repeated.
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()), "doc-prints")
    prints = found.select("_row", F.inline("prints"))
    theirs = items.withColumnsRenamed({"at": "item_at", "words": "item_words"})
    if items.count() <= BROADCAST_ROWS:
        pairs = prints.join(F.broadcast(theirs), ["print", "size"])
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        pairs = prints.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(
            theirs.withColumn("_salt", salt), ["print", "size", "_salt"]
        )
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    spans = pairs.select("_row", "item_id", "size", "at", "words", "item_words").mapInArrow(
        _extended, f"_row bigint, item_id {id_type}, first bigint, after bigint"
    )
    # Spans are sorted; each adds the words after the furthest end so far.
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("first", "after"))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda sum_, span: F.struct(
            (
                sum_["n"]
                + F.greatest(
                    F.lit(0).cast("bigint"),
                    span["after"] - F.greatest(span["first"], sum_["end"]),
                )
            ).alias("n"),
            F.greatest(sum_["end"], span["after"]).alias("end"),
        ),
    )
    hit = spans.groupBy("_row").agg(
        covered["n"].alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    return found.join(hit, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast(f"array<{id_type}>")).alias("items"),
    )


def _fingerprints(rows: DataFrame, key: str, shared, count: str | None) -> DataFrame:
    """Per row its fingerprints, with the words around each: all of an item's, and of a document's
    those in the bitmap, with its number of words."""
    key_type = rows.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, short = shared.value if shared is not None else (None, None)
        for batch in batches:
            for texts in text_slices(batch.column("text"), SMALL_SLICE_BYTES):
                keys = batch.column(key).slice(texts.first, len(texts))
                words, prints = _prints(texts, bitmap, short)
                columns, names = [keys, prints], [key, "prints"]
                if count:
                    columns.append(pa.array(words))
                    names.append(count)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    counted = f", {count} bigint" if count else ""
    return rows.select(key, "text").mapInArrow(find, f"{key} {key_type}, prints {_PRINTS}{counted}")


def _prints(
    texts: Texts, bitmap: np.ndarray | None, short: list[int] | None
) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and its fingerprints.

    Texts with a bitmap are documents, whose runs of every short length count; the others are
    items, of which those with less than a window of words have one fingerprint.
    """
    starts, ends = runs(texts.data, texts.offsets, ALPHANUMERIC)
    words = word_hashes(texts.data, starts, ends)
    # Words that are compared one by one have a hash of their own, independent of the fingerprints.
    compared = word_hashes(texts.data, starts, ends, seed=1)
    first = np.searchsorted(starts, texts.offsets)  # of each text, and the end
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    found = [_winnowed(words, owner)]
    if short is None:
        whole = np.flatnonzero((counts > 0) & (counts < WINDOW))
        for size in np.unique(counts[whole]):
            found.append(_grams(words, owner, int(size), first[whole[counts[whole] == size]]))
    else:
        found += [_grams(words, owner, size, None) for size in short]
    at, sizes, prints = (np.concatenate(x) for x in zip(*found))
    if bitmap is not None:
        low = prints & np.uint64(BITMAP_BITS - 1)
        kept = np.flatnonzero(bitmap[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))
        at, sizes, prints = at[kept], sizes[kept], prints[kept]
    order = np.lexsort((sizes, at))
    at, sizes, prints = at[order], sizes[order], prints[order]
    # The words around a gram, 0 outside its text; of a short item just its words.
    places = at[:, None] + np.arange(-_REACH, GRAM + _REACH)
    whole = sizes[:, None] == WINDOW
    places = np.where(whole, places, at[:, None] + np.arange(_CONTEXT))
    low, high = first[owner[at]][:, None], first[owner[at] + 1][:, None]
    inside = (places >= low) & (places < high) & (whole | (np.arange(_CONTEXT) < sizes[:, None]))
    around = np.zeros(places.shape, np.uint64)
    around[inside] = compared[places[inside]] | np.uint64(1)
    buffer = pa.py_buffer(np.ascontiguousarray(around))
    ends_at = (np.arange(len(at) + 1) * _CONTEXT * 8).astype(np.int32)
    rows = pa.StructArray.from_arrays(
        [
            pa.array(prints.view(np.int64)),
            pa.array(sizes.astype(np.int32)),
            pa.array(at - first[owner[at]]),
            pa.BinaryArray.from_buffers(
                pa.binary(), len(at), [None, pa.py_buffer(ends_at), buffer]
            ),
        ],
        fields=list(_PRINT),
    )
    cuts = np.searchsorted(owner[at], np.arange(len(texts) + 1)).astype(np.int32)
    return counts, pa.ListArray.from_arrays(pa.array(cuts), rows)


def _winnowed(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, sizes and hashes of the fingerprints of all full windows."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words, GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    least = windows.argmin(1) + np.arange(len(windows))
    least = np.unique(least[owner[: len(windows)] == owner[WINDOW - 1 :]])
    return least, np.full(len(least), WINDOW), grams[least]


def _grams(
    words: np.ndarray, owner: np.ndarray, size: int, chosen: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of so many words inside one text, or those at the chosen places."""
    grams = mix(gram_hashes(words, size) + np.uint64(size))
    at = np.flatnonzero(owner[: len(grams)] == owner[size - 1 :]) if chosen is None else chosen
    return at, np.full(len(at), size), grams[at]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches with as many equal words on both sides as make up a window; short ones whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        same = _words(batch.column("words")) == _words(batch.column("item_words"))
        size, at = batch.column("size").to_numpy(), batch.column("at").to_numpy()
        known = _words(batch.column("words")) != 0
        left = np.cumprod((same & known)[:, :_REACH][:, ::-1], axis=1).sum(1)
        right = np.cumprod((same & known)[:, _REACH + GRAM :], axis=1).sum(1)
        whole = size < WINDOW
        hit = same[:, _REACH : _REACH + GRAM].all(1) & (left + right >= _REACH)
        hit = np.flatnonzero(np.where(whole, same.all(1), hit))
        first = np.where(whole, at, at - left)
        after = np.where(whole, at + size, at + GRAM + right)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_row").take(pa.array(hit)),
                batch.column("item_id").take(pa.array(hit)),
                pa.array(first[hit]),
                pa.array(after[hit]),
            ],
            names=["_row", "item_id", "first", "after"],
        )


def _words(column: pa.Array) -> np.ndarray:
    joined = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
    return joined.reshape(-1, _CONTEXT)
