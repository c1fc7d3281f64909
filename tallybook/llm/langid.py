"""Language of each word by a linear-chain conditional random field, and of each document.

Words are runs of letters. A word's features are hashed: the word itself (lexicon), its prefixes
and suffixes (affixes) and the byte pairs and triples inside (n-grams). Weights per feature and
language, and the transitions between the languages of neighbouring words, are learnt together
from word sequences that splice stretches of several documents, so that switches occur in them.
Forward-backward gives each word its probabilities; a document's are their mean by length of word.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.arrays import (
    LETTERS,
    SMALL_SLICE_BYTES,
    Texts,
    lower_ascii,
    many_span_hashes,
    runs,
    text_slices,
)

FEATURE_BITS = 18
UNDETERMINED = "und"
# The model is fitted to stretches of at most so many documents.
SAMPLE_DOCS = 3000
STRETCHES = 8
STRETCH_WORDS = 16
_SEQUENCE = 3  # stretches
_PREFIXES = 1, 2, 3
_SUFFIXES = 2, 3, 4
_BLOCK = 128
_MODEL = "languages array<string>, weights binary, transitions binary, start binary"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature, language
    transitions: np.ndarray  # from, to
    start: np.ndarray


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """A fixed third of the documents, by id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, seed: int = 0, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit the model to documents with a language, of which ``sample_docs`` are drawn by id.

    Of each, at most ``STRETCHES`` stretches of ``STRETCH_WORDS`` words are taken, evenly over its
    whole text. One task fits the model to this bounded sample.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    drawn = (
        labelled.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("_draw"))
        .orderBy("_draw", "doc_id")
        .limit(sample_docs)
        .select("doc_id")
        .distinct()
    )
    stretches = (
        labelled.join(F.broadcast(drawn), "doc_id")
        .select("doc_id", "lang", "text")
        .mapInArrow(_stretches, "lang string, text string")
    )
    row = stretches.repartition(1).mapInArrow(_fitter(seed), _MODEL).first()
    if row is None:
        empty = np.zeros((1 << FEATURE_BITS, 0), np.float32)
        return Model([], empty, np.zeros((0, 0)), np.zeros(0))
    n = len(row.languages)
    return Model(
        row.languages,
        np.frombuffer(row.weights, np.float32).reshape(-1, n),
        np.frombuffer(row.transitions, np.float64).reshape(n, n),
        np.frombuffer(row.start, np.float64),
    )


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, its probability, to ``doc_id`` or the given columns.

    A text without letters, an empty or null one is ``und`` with score 0; so is every text where
    no language was learnt. Texts of any length are used whole. Given columns of these names are
    replaced. An empty table gives no rows, repeated rows equal answers.
    """
    columns = [c for c in columns or ["doc_id"] if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    read = docs.select(*columns, *[] if "text" in columns else ["text"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, scores = _column(batch.column("text"), shared.value)
            names = [*shared.value.languages, UNDETERMINED]
            predicted = pa.array(names, pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], predicted, pa.array(scores)],
                names=[*columns, "lang_pred", "score"],
            )

    return read.mapInArrow(label, f"{fields}, lang_pred string, score double")


# --- features --------------------------------------------------------------------------------


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(data, offsets, LETTERS)


def _feature(hashes: np.ndarray, kind: int) -> np.ndarray:
    salted = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & (1 << 64) - 1)) * np.uint64(
        0xD6E8FEB86659FD93
    )
    return (salted >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each kind of lexicon or affix feature, its number for every word."""
    spans = [(starts, ends)]
    spans += [(starts, np.minimum(starts + n, ends)) for n in _PREFIXES]
    spans += [(np.maximum(ends - n, starts), ends) for n in _SUFFIXES]
    with np.errstate(over="ignore"):
        return [_feature(h, kind) for kind, h in enumerate(many_span_hashes(data, spans))]


def _gram_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For byte pairs and triples, the feature that starts at each byte; -1 outside words."""
    size = len(data)
    lower = lower_ascii()[data].astype(np.uint64)
    room = np.zeros(size + 1, np.int32)  # bytes from here to the end of the word
    room[starts] += 1
    room[ends] -= 1
    inside = np.cumsum(room[:-1]) > 0
    last = np.zeros(size, bool)
    last[ends - 1] = True
    found = []
    code, whole = lower, inside.copy()
    with np.errstate(over="ignore"):
        for n in (2, 3):
            code = code[:-1] << np.uint64(8) | lower[n - 1 :] if size >= n else code[:0]
            whole = whole[: len(code)] & ~last[n - 2 : n - 2 + len(code)]
            kind = _feature(code * np.uint64(0x9FB21C651E98DF25), 20 + n)
            found.append(np.where(whole, kind, -1))
    return found


def _emissions(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """Sum of the weights of each word's features, by language."""
    scores = np.zeros((len(starts), weights.shape[1]))
    for kind in _word_features(data, starts, ends):
        scores += weights[kind]
    for kind in _gram_features(data, starts, ends):
        at = np.flatnonzero(kind >= 0)
        sums = np.zeros((len(at) + 1, weights.shape[1]))
        np.cumsum(weights[kind[at]], axis=0, out=sums[1:], dtype=np.float64)
        scores += sums[np.searchsorted(at, ends)] - sums[np.searchsorted(at, starts)]
    return scores


# --- forward-backward ------------------------------------------------------------------------


def _posteriors(emissions: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Probabilities of each word's languages; ``first`` marks words that begin a document.

    All documents are one chain that forgets at each ``first``. It is cut into blocks that advance
    together: products of the blocks, messages between them, then messages within.
    """
    count, n = emissions.shape
    n_blocks = -(-count // _BLOCK)
    held = np.ones((n_blocks * _BLOCK, n))
    held[:count] = np.exp(emissions - emissions.max(1, keepdims=True)) + 1e-30
    begins = np.ones(n_blocks * _BLOCK, bool)
    begins[:count] = first
    held, begins = held.reshape(n_blocks, _BLOCK, n), begins.reshape(n_blocks, _BLOCK)
    change = np.exp(model.transitions - model.transitions.max())
    start = np.exp(model.start - model.start.max())

    products = np.broadcast_to(np.eye(n), (n_blocks, n, n))
    for t in range(_BLOCK):
        fresh = products.sum(2)[:, :, None] * start
        products = np.where(begins[:, t, None, None], fresh, products @ change)
        products = products * held[:, t, None, :]
        products /= products.sum((1, 2), keepdims=True)

    into, out_of = np.empty((n_blocks, n)), np.empty((n_blocks, n))
    message = np.ones(n)
    for b in range(n_blocks):
        into[b] = message
        message = message @ products[b]
        message /= message.sum()
    message = np.ones(n)
    for b in range(n_blocks - 1, -1, -1):
        out_of[b] = message
        message = products[b] @ message
        message /= message.sum()

    forward = np.empty_like(held)
    message = into
    for t in range(_BLOCK):
        message = np.where(begins[:, t, None], start, message @ change) * held[:, t]
        message = message / message.sum(1, keepdims=True)
        forward[:, t] = message
    message = out_of
    for t in range(_BLOCK - 1, -1, -1):
        forward[:, t] *= message
        ahead = message * held[:, t]
        message = np.where(
            begins[:, t, None], (ahead @ start)[:, None], ahead @ change.T
        )
        message = message / message.sum(1, keepdims=True)
    found = forward.reshape(-1, n)[:count]
    return found / found.sum(1, keepdims=True)


def word_languages(texts: Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some texts, and their languages' probabilities."""
    starts, ends = _words(texts.data, texts.offsets)
    if not len(starts):
        return starts, ends, np.zeros((0, len(model.languages)))
    owner = np.searchsorted(texts.offsets, starts, "right")
    first = np.diff(owner, prepend=-1) != 0
    emissions = _emissions(texts.data, starts, ends, model.weights)
    return starts, ends, _posteriors(emissions, first, model)


def _column(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``_documents`` of a column's texts, of which there is at least one."""
    slices = text_slices(column, SMALL_SLICE_BYTES)
    best, scores = zip(*[_documents(texts, model) for texts in slices])
    return np.concatenate(best), np.concatenate(scores)


def _documents(texts: Texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text, and its probability."""
    n = len(model.languages)
    best, score = np.full(len(texts), n), np.zeros(len(texts))
    if not n:
        return best, score
    starts, ends, found = word_languages(texts, model)
    cuts = np.searchsorted(starts, texts.offsets)
    sums = np.zeros((len(starts) + 1, n))
    np.cumsum(found * (ends - starts)[:, None], axis=0, out=sums[1:])
    shares = sums[cuts[1:]] - sums[cuts[:-1]]
    worded = _with_letters(texts, starts, ends, cuts)
    best[worded] = shares[worded].argmax(1)
    score[worded] = shares[worded].max(1) / shares[worded].sum(1)
    return best, np.clip(score, 0.0, 1.0)


def _with_letters(
    texts: Texts, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray
) -> np.ndarray:
    """Texts with a letter. Characters over U+007F count as parts of words; whether a text of
    nothing else has a letter is asked of each character."""
    ascii_letter = LETTERS.copy()
    ascii_letter[0x80:] = False
    at = np.concatenate([[0], np.cumsum(ascii_letter[texts.data])])
    plain = at[texts.offsets[1:]] > at[texts.offsets[:-1]]
    for i in np.flatnonzero(~plain & (cuts[1:] > cuts[:-1])):
        text = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode()
        plain[i] = any(character.isalpha() for character in text)
    return np.flatnonzero(plain)


# --- fitting ---------------------------------------------------------------------------------


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words, evenly over each text; all of them where a text has no more."""
    for batch in batches:
        languages, pieces = [], []
        for texts in text_slices(batch.column("text")):
            starts, ends = _words(texts.data, texts.offsets)
            cuts = np.searchsorted(starts, texts.offsets)
            for i in range(len(texts)):
                count = cuts[i + 1] - cuts[i]
                taken = min(-(-count // STRETCH_WORDS), STRETCHES)
                for k in range(taken):
                    begin = cuts[i] + k * count // taken
                    after = min(begin + STRETCH_WORDS, cuts[i + 1])
                    words = [
                        texts.data[a:b].tobytes().decode()
                        for a, b in zip(starts[begin:after], ends[begin:after])
                    ]
                    languages.append(batch.column("lang")[texts.first + i].as_py())
                    pieces.append(" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.string()), pa.array(pieces, pa.string())],
            names=["lang", "text"],
        )


def _fitter(seed: int):
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            row
            for batch in batches
            for row in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
        ]
        if rows:
            model = fit(sorted(rows), seed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([model.languages], pa.list_(pa.string())),
                    *[
                        pa.array([x.tobytes()], pa.binary())
                        for x in (model.weights, model.transitions, model.start)
                    ],
                ],
                names=["languages", "weights", "transitions", "start"],
            )

    return fitted


def fit(
    rows: list[tuple[str, str]], seed: int = 0, epochs: int = 3, batch: int = 48, rate: float = 0.3
) -> Model:
    """Maximise the likelihood of the languages of spliced sequences, by Adagrad steps.

    A sequence has up to three stretches drawn at random, of one language or of several.
    """
    random = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    n = len(languages)
    label = np.array([languages.index(lang) for lang, _ in rows])
    joined = pa.array([text for _, text in rows])
    texts = next(text_slices(joined, 1 << 40))
    starts, ends = _words(texts.data, texts.offsets)
    cuts = np.searchsorted(starts, texts.offsets)
    features, at = _feature_table(texts.data, starts, ends)

    weights = np.zeros((1 << FEATURE_BITS, n), np.float32)
    squares = np.full((1 << FEATURE_BITS, n), 1e-2, np.float32)
    chain = np.zeros((n + 1, n))  # transitions, and the start as last row
    chain_squares = np.full((n + 1, n), 1e-2)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        # Half of the sequences stay with one language: a splice joins equal labels as well.
        groups = [order[i : i + _SEQUENCE] for i in range(0, len(order), _SEQUENCE)]
        for i in range(0, len(groups), batch):
            chosen = groups[i : i + batch]
            words, truth, first = [], [], []
            for stretches in chosen:
                if random.random() < 0.5:
                    stretches = stretches[label[stretches] == label[stretches[0]]]
                run = np.concatenate([np.arange(cuts[s], cuts[s + 1]) for s in stretches])
                words.append(run)
                truth.append(np.repeat(label[stretches], cuts[stretches + 1] - cuts[stretches]))
                first.append(np.arange(len(run)) == 0)
            _step(
                np.concatenate(words), np.concatenate(truth), np.concatenate(first),
                features, at, weights, squares, chain, chain_squares, rate,
            )
    return Model(languages, weights, chain[:n].copy(), chain[n].copy())


def _feature_table(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words one after the other, and where each word's begin."""
    owners, kinds = [], []
    for kind in _word_features(data, starts, ends):
        owners.append(np.arange(len(starts)))
        kinds.append(kind)
    for kind in _gram_features(data, starts, ends):
        at = np.flatnonzero(kind >= 0)
        owners.append(np.searchsorted(starts, at, "right") - 1)
        kinds.append(kind[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(kinds)[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


def _step(words, truth, first, features, at, weights, squares, chain, chain_squares, rate) -> None:
    n = weights.shape[1]
    sizes = at[words + 1] - at[words]
    local = np.concatenate([[0], np.cumsum(sizes)])
    flat = features[np.repeat(at[words] - local[:-1], sizes) + np.arange(local[-1])]
    emissions = np.add.reduceat(weights[flat].astype(np.float64), local[:-1], axis=0)
    model = Model([], weights, chain[:n], chain[n])
    expected, pairs, starts = _expectations(emissions, first, model)
    error = expected
    error[np.arange(len(truth)), truth] -= 1.0
    follows = np.flatnonzero(~first)
    np.add.at(pairs, (truth[follows - 1], truth[follows]), -1.0)
    np.add.at(starts, truth[first], -1.0)
    scale = 1.0 / max(first.sum(), 1)

    used, place = np.unique(flat, return_inverse=True)
    gradient = np.stack(
        [np.bincount(place, np.repeat(error[:, k], sizes), len(used)) for k in range(n)], axis=1
    ) * scale + 1e-5 * weights[used]
    squares[used] += gradient**2
    weights[used] -= rate * gradient / np.sqrt(squares[used])
    gradient = np.concatenate([pairs, starts[None]]) * scale + 1e-3 * chain
    chain_squares += gradient**2
    chain -= rate * gradient / np.sqrt(chain_squares)


def _expectations(
    emissions: np.ndarray, first: np.ndarray, model: Model
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected languages of words, pairs of neighbours and starts; sequences advance together."""
    heads = np.flatnonzero(first)
    length = np.diff(np.append(heads, len(first)))
    order = np.argsort(-length, kind="stable")
    heads, length = heads[order], length[order]
    n = emissions.shape[1]
    held = np.exp(emissions - emissions.max(1, keepdims=True)) + 1e-30
    change = np.exp(model.transitions - model.transitions.max())
    start = np.exp(model.start - model.start.max())
    forward, backward = np.empty_like(held), np.ones_like(held)
    for t in range(length[0]):
        rows = heads[: np.count_nonzero(length > t)]
        message = (start if t == 0 else forward[rows + t - 1] @ change) * held[rows + t]
        forward[rows + t] = message / message.sum(1, keepdims=True)
    pairs = np.zeros((n, n))
    for t in range(length[0] - 1, 0, -1):
        rows = heads[: np.count_nonzero(length > t)]
        ahead = held[rows + t] * backward[rows + t]
        joint = forward[rows + t - 1][:, :, None] * change * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        message = ahead @ change.T
        backward[rows + t - 1] = message / message.sum(1, keepdims=True)
    expected = forward * backward
    expected /= expected.sum(1, keepdims=True)
    return expected, pairs, expected[heads].sum(0)
