"""Quality scores: random-indexing word vectors, pooled, and a small calibrated network.

Tokens are runs of letters, of digits or of other characters, hashed with their case into
``BUCKETS``. Each bucket has a fixed sparse random vector; its context vector is the sum of the
random vectors of the tokens next to it, over all texts of the corpus. A document is the pooled
(mean, spread, mean over distinct) context vectors of its tokens with two counts. A two-layer
network, fitted to a bounded sample of labelled documents, scores that, and a temperature fitted
to a part of the sample that the network has not seen calibrates its probabilities.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.arrays import Texts, byte_class, mix, span_hashes, text_slices

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SIZE = 32
NONZERO = 4
REACH = 2
# The network is fitted to at most so many labelled documents.
SAMPLE_DOCS = 8000
HIDDEN = 32
_CHUNK_ROWS = 512
_N_FEATURES = 3 * SIZE + 2

_KIND = np.full(256, 3, np.uint8)
_KIND[byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 1
_KIND[byte_class((0x30, 0x39))] = 2
_KIND[byte_class((0x20, 0x20), (0x09, 0x0D))] = 0


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(features) / self.temperature)

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.mean) / self.scale @ self.inner + self.inner_bias)
        return hidden @ self.outer + self.outer_bias


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vector of each bucket, of length 1 where it has one; over all texts.

    Tasks add up tables of one fixed size (4 MB), which are summed by pieces of rows.
    """
    size = _CHUNK_ROWS * SIZE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * SIZE, np.int64)
        places, signs = _random_vectors()
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                tokens, owner = _tokens(texts)
                for step in range(1, REACH + 1):
                    near = owner[step:] == owner[:-step]
                    a, b = tokens[:-step][near], tokens[step:][near]
                    _add_contexts(sums, a, b, places, signs)
                    _add_contexts(sums, b, a, places, signs)
        pieces = np.arange(BUCKETS // _CHUNK_ROWS)
        used = [k for k in pieces if sums[k * size : (k + 1) * size].any()]
        yield _pieces(used, [sums[k * size : (k + 1) * size] for k in used])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist())
            for piece, sums in rows:
                totals.setdefault(piece, np.zeros(size, np.int64))
                totals[piece] += np.frombuffer(sums, np.int64)
        yield _pieces(list(totals), list(totals.values()))

    counted = docs.select("text").mapInArrow(count, "piece int, sums binary")
    table = np.zeros(BUCKETS * SIZE)
    # BUCKETS / _CHUNK_ROWS rows, 8 MB in all.
    for row in counted.repartition("piece").mapInArrow(add, "piece int, sums binary").collect():
        table[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.sums, np.int64)
    table = table.reshape(BUCKETS, SIZE)
    length = np.sqrt((table**2).sum(1, keepdims=True))
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def train(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, seed: int = 0,
    sample_docs: int = SAMPLE_DOCS,
) -> Network | None:
    """Fit the network to ``sample_docs`` of the labelled documents, drawn by id; one task does.

    ``labels`` has ``doc_id`` and ``quality`` 0 or 1 (others are left out; of several labels of a
    document the greatest counts). None if no labelled document is there.
    """
    drawn = (
        labels.where("quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id"))
        .orderBy("_draw", "doc_id")
        .limit(sample_docs)
        .drop("_draw")
    )
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_features(t, shared.value) for t in text_slices(batch.column("text"))]
            rows = [row.astype(np.float32).tobytes() for part in found for row in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality"), pa.array(rows, pa.binary())], names=["quality", "row"]
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            row
            for batch in batches
            for row in zip(batch.column("row").to_pylist(), batch.column("quality").to_pylist())
        )
        if rows:
            table = np.frombuffer(b"".join(r for r, _ in rows), np.float32)
            network = fit(
                table.reshape(-1, _N_FEATURES).astype(np.float64),
                np.array([float(q) for _, q in rows]), seed,
            )
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)])], names=["network"])

    row = (
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .select("text", F.col("quality").cast("int"))
        .mapInArrow(features, "quality int, row binary")
        .repartition(1)
        .mapInArrow(fitted, "network binary")
        .first()
    )
    return None if row is None else pickle.loads(row.network)


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None) -> DataFrame:
    """``doc_id`` and ``score`` of every row; null and empty texts have that of no tokens.

    Whole texts count, labels, ids and other columns do not. Without a network all scores are 0.5.
    An empty table gives no rows, repeated rows equal scores.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(texts.first, len(texts))
                if network is None:
                    scores = np.full(len(texts), 0.5)
                else:
                    scores = network.scores(_features(texts, vectors).astype(np.float64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(scores)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, score double")


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens, and the text of each."""
    kind = _KIND[texts.data]
    changes = np.empty(len(kind), bool)
    changes[:1] = True
    changes[1:] = kind[1:] != kind[:-1]
    changes[texts.offsets[:-1][texts.offsets[:-1] < len(kind)]] = True
    starts = np.flatnonzero(changes)
    ends = np.append(starts[1:], len(kind))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    hashes = span_hashes(texts.data, starts, ends, lower=False)
    tokens = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return tokens, np.searchsorted(texts.offsets, starts, "right") - 1


def _random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its few nonzero entries, and their signs."""
    bucket = np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(NONZERO)
    drawn = mix(bucket + np.arange(1, NONZERO + 1, dtype=np.uint64))
    places = (drawn % np.uint64(SIZE)).astype(np.int64)
    return places, (drawn >> np.uint64(63)).astype(np.int64) * 2 - 1


def _add_contexts(sums, of, context, places, signs) -> None:
    for k in range(NONZERO):
        at = of * SIZE + places[context, k]
        sums += np.bincount(at, signs[context, k], len(sums)).astype(np.int64)


def _pieces(pieces: list, sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(pieces, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())],
        names=["piece", "sums"],
    )


def _features(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """The pooled vectors of each text: mean, spread, mean over distinct tokens, and counts."""
    tokens, owner = _tokens(texts)
    n = len(texts)
    counts = np.bincount(owner, minlength=n)
    rows = vectors[tokens].astype(np.float64)
    mean = _sums(rows, counts) / np.maximum(counts, 1)[:, None]
    square = _sums(rows**2, counts) / np.maximum(counts, 1)[:, None]
    pairs = np.unique(owner * BUCKETS + tokens)
    kinds = np.bincount(pairs >> BUCKET_BITS, minlength=n)
    distinct = _sums(vectors[pairs & (BUCKETS - 1)].astype(np.float64), kinds)
    return np.concatenate(
        [
            mean,
            np.sqrt(np.maximum(square - mean**2, 0)),
            distinct / np.maximum(kinds, 1)[:, None],
            np.log1p(counts)[:, None],
            (kinds / np.maximum(counts, 1))[:, None],
        ],
        axis=1,
    )


def _sums(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(counts), rows.shape[1]))
    held = counts > 0
    if len(rows):
        sums[held] = np.add.reduceat(rows, (np.cumsum(counts) - counts)[held], axis=0)
    return sums


def fit(
    rows: np.ndarray, labels: np.ndarray, seed: int = 0, epochs: int = 60, batch: int = 64,
    rate: float = 3e-3,
) -> Network:
    """Adam steps on four fifths of the rows, the temperature on the others."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    aside = order[: len(rows) // 5]
    used = order[len(rows) // 5 :]
    mean, scale = rows[used].mean(0), rows[used].std(0) + 1e-6
    rows = (rows - mean) / scale
    shapes = [(rows.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    weights = [random.normal(0, 1 / np.sqrt(rows.shape[1]), shapes[0]), np.zeros(HIDDEN),
               random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first = [np.zeros(s) for s in shapes]
    second = [np.zeros(s) for s in shapes]
    step = 0
    for _ in range(epochs):
        mixed = random.permutation(used)
        for i in range(0, len(mixed), batch):
            step += 1
            x, y = rows[mixed[i : i + batch]], labels[mixed[i : i + batch]]
            hidden = np.tanh(x @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - y) / len(y)
            back = error[:, None] * weights[2] * (1 - hidden**2)
            gradients = [x.T @ back + 1e-4 * weights[0], back.sum(0),
                         hidden.T @ error + 1e-4 * weights[2], error.sum()]
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                up, down = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                weights[k] = weights[k] - rate * up / (np.sqrt(down) + 1e-8)
    network = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3]), 1.0)
    hidden = np.tanh(rows[aside] @ weights[0] + weights[1])
    network.temperature = temperature(hidden @ weights[2] + weights[3], labels[aside])
    return network


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What the logits are best divided by, by likelihood; 1 where there is nothing to fit to."""
    if len(set(labels.tolist())) < 2:
        return 1.0
    tried = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    losses = [np.logaddexp(0, np.where(labels == 1, -1, 1) * logits / t).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
