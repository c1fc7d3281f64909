"""Byte-level BPE encoding and decoding with the vocabulary of a tokenizer file.

A text is split into words by the pattern of byte-level tokenizers, and each word is merged by the
model of the ``tokenizers`` library. Long texts are cut into pieces, which are encoded in parallel,
wherever they are cut, and joined two by two:

1. Words are found from left to right, and a word's end depends on a few characters after it. So
   the last word of the left piece that begins well before its end begins a word of the whole text.
   From there the words are found again, in a window that grows until one of them begins where a
   word of the right piece does: from there on both go on alike.
2. A long word across the cut is not merged again. Tokens are what the model gives for their text if
   any two neighbours are what it gives for the text of the two. So the tokens around the cut are
   merged again in a window that grows until its first token is the left side's and its last token
   is the right side's: every two neighbours then stand together in one of the three.

A long word within a piece is halved and joined by the second rule.
"""

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)
from tokenizers import Tokenizer

# Fixed value: the pattern by which byte-level tokenizers find words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes that stand for themselves in a vocabulary; the others come after them.
_PRINTED = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

PIECE_CHARS = 1 << 15
LONG_WORD = 512
# What a word's end can depend on: three characters of up to four bytes.
_AHEAD = 12
_FIRST_BYTES, _FIRST_TOKENS = 64, 4
_REMEMBERED, _SHORT = 200_000, 48
_BATCH_TOKENS = 1 << 19


@dataclass
class Encoded:
    """Tokens of a text, and which of them begin a word."""

    ids: np.ndarray
    heads: np.ndarray


def encode(
    texts: DataFrame,
    tokenizer: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The ``keep`` columns of every row and ``ids``, the tokens of its whole text.

    ``tokenizer`` is the path of a byte-level BPE tokenizer file; the driver reads it. Tokens equal
    those of the ``tokenizers`` library without added special tokens; the string of a special token
    inside a text is that token. Null and empty texts have no tokens. Texts of more than
    ``piece_chars`` are cut and joined again, and only the joining needs the tokens of one text in
    one place. Repeated rows, and rows of equal or null ids, are encoded each; no rows give no rows.
    Other columns are not read, whatever they are called.
    """
    spark = texts.sparkSession
    vocabulary = spark.sparkContext.broadcast(_read(tokenizer))
    rows = texts.select(
        F.struct(F.lit(True).alias("_any"), *keep).alias("_row"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    row = rows.schema["_row"]
    id_and_piece = [StructField("_id", LongType()), StructField("_piece", IntegerType())]
    tokens = StructType([row, StructField("ids", ArrayType(IntegerType()))])
    text_piece = StructType([*id_and_piece, row, StructField("_text", StringType())])
    packed = [StructField("ids", BinaryType()), StructField("heads", BinaryType())]
    encoded_piece = StructType([*id_and_piece, row, *packed])
    long = F.char_length("_text") > piece_chars
    short = rows.where(~long).mapInArrow(
        lambda batches: _encode_rows(batches, vocabulary), tokens
    )
    pieces = (
        rows.where(long)
        .withColumn("_id", F.monotonically_increasing_id())
        .mapInArrow(lambda batches: _cut_rows(batches, vocabulary, piece_chars), text_piece)
        .repartition("_id", "_piece")
        .mapInArrow(lambda batches: _encode_pieces(batches, vocabulary), encoded_piece)
    )
    joined = pieces.groupBy("_id").applyInArrow(
        lambda table: _join_pieces(table, vocabulary), tokens
    )
    found = short.unionByName(joined)
    return found.select(*[F.col("_row")[c].alias(c) for c in keep], "ids")


def decode(
    encoded: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids"
) -> DataFrame:
    """The ``keep`` columns of every row and ``text``, what its tokens stand for.

    Special tokens give their strings, numbers that are no token give nothing, and bytes that are
    no UTF-8 become U+FFFD. Null is like no tokens: an empty text.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(_read(tokenizer))
    rows = encoded.select(
        F.struct(F.lit(True).alias("_any"), *keep).alias("_row"),
        F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"),
    )
    texts = StructType([rows.schema["_row"], StructField("text", StringType())])
    found = rows.mapInArrow(lambda batches: _decode_rows(batches, vocabulary), texts)
    return found.select(*[F.col("_row")[c].alias(c) for c in keep], "text")


class Coder:
    """Encodes and decodes single texts by a tokenizer file's content."""

    def __init__(self, content: str) -> None:
        self.model = Tokenizer.from_str(content).model
        given = json.loads(content)
        tokens = {i: token for token, i in given["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        letters, spare = {}, 256
        for byte in range(256):
            if any(low <= byte <= high for low, high in _PRINTED):
                letters[byte] = chr(byte)
            else:
                letters[byte], spare = chr(spare), spare + 1
        self.letters = letters
        byte_of = {ord(letter): byte for byte, letter in letters.items()}
        self.bytes_of = [b""] * (max([*tokens, *self.special.values()]) + 1)
        for i, token in tokens.items():
            self.bytes_of[i] = token.translate(byte_of).encode("latin-1")
        for string, i in self.special.items():
            self.bytes_of[i] = string.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.words = regex.compile(WORDS)
        # Of strings that begin at one place the longest counts.
        strings = sorted(self.special, key=len, reverse=True)
        self.strings = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.remembered: dict[str, list[int]] = {}

    def cuts(self, text: str, size: int) -> list[str]:
        """The text in pieces of about ``size`` characters, no special string cut in two."""
        spans = [m.span() for m in self.strings.finditer(text)] if self.strings else []
        ends = np.arange(size, len(text), size)
        for first, after in spans:
            ends[(ends > first) & (ends < after)] = after
        ends = [0, *sorted(set(ends.tolist()) - {len(text)}), len(text)]
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def split(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The words of a text; for a special string, its token as well."""
        at = 0
        for match in self.strings.finditer(text) if self.strings else ():
            for word in self.words.findall(text[at : match.start()]):
                yield word, None
            yield match[0], self.special[match[0]]
            at = match.end()
        for word in self.words.findall(text[at:]):
            yield word, None

    def encode_text(self, text: str) -> list[int]:
        ids, remembered = [], self.remembered
        for word, special in self.split(text):
            if special is not None:
                ids.append(special)
            else:
                known = remembered.get(word)
                ids.extend(self.encode_word(word) if known is None else known)
        return ids

    def encode_piece(self, text: str) -> Encoded:
        ids, heads = [], []
        for word, special in self.split(text):
            tokens = self.encode_word(word) if special is None else [special]
            heads.append(len(ids))
            ids.extend(tokens)
        marks = np.zeros(len(ids), bool)
        marks[heads] = True
        return Encoded(np.array(ids, np.int32), marks)

    def encode_word(self, word: str) -> list[int]:
        known = self.remembered.get(word)
        if known is not None:
            return known
        data = word.encode()
        ids = self.merge(data)
        if len(data) <= _SHORT:
            if len(self.remembered) >= _REMEMBERED:
                self.remembered.clear()
            self.remembered[word] = ids
        return ids

    def merge(self, word: bytes) -> list[int]:
        """The tokens of a word, a long one by halves."""
        if len(word) <= LONG_WORD:
            return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
        half = len(word) // 2
        return self.join_words(self.merge(word[:half]), b"", self.merge(word[half:]))

    def join_words(self, left: list[int], between: bytes, right: list[int]) -> list[int]:
        """The tokens of one word, given those of its beginning and of its end."""
        n_left = n_right = _FIRST_TOKENS
        while True:
            n_left, n_right = min(n_left, len(left)), min(n_right, len(right))
            a = len(left) - n_left
            window = self.data(left[a:]) + between + self.data(right[:n_right])
            # A window of the whole word is no easier than the word; it is never halved again.
            tokens = [
                t.id for t in self.model.tokenize(window.decode("latin-1").translate(self.letters))
            ]
            left_agrees = a == 0 or tokens[0] == left[a]
            right_agrees = n_right == len(right) or tokens[-1] == right[n_right - 1]
            if left_agrees and right_agrees:
                return left[:a] + tokens + right[n_right:]
            n_left = n_left if left_agrees else n_left * 2
            n_right = n_right if right_agrees else n_right * 2

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The tokens of two texts as one text."""
        if not len(left.ids) or not len(right.ids):
            return left if len(left.ids) else right
        a = self._last_sure_head(left)
        tail = self.data(left.ids[a:])
        ends = np.cumsum(self.lengths[right.ids])
        # Places in the right text where a word begins, and its end.
        heads = np.append(np.flatnonzero(right.heads), len(right.ids))
        places = np.append(0, ends)[heads]
        reach = _FIRST_BYTES
        while True:
            last = min(int(np.searchsorted(places, reach)), len(heads) - 1)
            window = tail + self.data(right.ids[: heads[last]])
            words = list(self.split(window.decode()))
            begins = np.cumsum([0] + [len(word.encode()) for word, _ in words])
            whole = last == len(heads) - 1
            sure = begins if whole else begins[begins <= len(window) - _AHEAD]
            agreed = np.intersect1d(sure - len(tail), places[: last + 1])
            if len(agreed):
                break
            reach *= 4
        place = int(agreed[0])
        b = int(heads[np.searchsorted(places, place)])
        n_words = int(np.searchsorted(begins, place + len(tail)))
        ids, firsts = [], []
        for i, (word, special) in enumerate(words[:n_words]):
            firsts.append(len(ids))
            if special is not None:
                ids.append(special)
            elif len(word.encode()) <= LONG_WORD:
                ids.extend(self.encode_word(word))
            else:
                begin, end = int(begins[i]), int(begins[i + 1])
                ids.extend(self._across(word.encode(), begin, end, left, a, right, b, len(tail)))
        marks = np.zeros(len(ids), bool)
        marks[firsts] = True
        return Encoded(
            np.concatenate([left.ids[:a], np.array(ids, np.int32), right.ids[b:]]),
            np.concatenate([left.heads[:a], marks, right.heads[b:]]),
        )

    def _across(
        self, word: bytes, begin: int, end: int, left: Encoded, a: int, right: Encoded, b: int, cut: int
    ) -> list[int]:
        """The tokens of a long word of the window, with what the two sides know of it.

        The word has the bytes ``begin`` to ``end`` of a window that begins with token ``a`` of the
        left side, is cut after ``cut`` bytes, and holds words up to token ``b`` of the right side.
        """
        known: list[int] = []
        if begin == 0:
            heads = np.flatnonzero(left.heads[a + 1 :])
            stop = a + 1 + int(heads[0]) if len(heads) else len(left.ids)
            fits = np.cumsum(self.lengths[left.ids[a:stop]]) <= end
            known = left.ids[a:stop][fits].tolist()
        after: list[int] = []
        if b and cut + int(self.lengths[right.ids[:b]].sum()) == end:
            head = int(np.flatnonzero(right.heads[:b])[-1])
            if cut + int(self.lengths[right.ids[:head]].sum()) >= begin:
                after = right.ids[head:b].tolist()
        used, rest = len(self.data(known)), len(self.data(after))
        between = word[used : len(word) - rest]
        if len(between) > 2 * LONG_WORD:
            known, between = self.join_words(known, b"", self.merge(between)), b""
        return self.join_words(known, between, after)

    def _last_sure_head(self, left: Encoded) -> int:
        """The last token that begins a word whatever text follows."""
        rest = np.cumsum(self.lengths[left.ids[::-1]])[::-1]
        heads = np.flatnonzero(left.heads & (rest >= _AHEAD))
        return int(heads[-1]) if len(heads) else 0

    def join_all(self, parts: list[Encoded]) -> Encoded:
        """Joins neighbours, then neighbours of these, until one is left."""
        while len(parts) > 1:
            pairs = [self.join(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0]

    def data(self, ids: Sequence[int]) -> bytes:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_ids(self, ids: list[int]) -> str:
        known = len(self.bytes_of)
        if ids and not 0 <= min(ids) <= max(ids) < known:
            ids = [i for i in ids if 0 <= i < known]
        return self.data(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _coder(content: str) -> Coder:
    return Coder(content)


def _read(path: str) -> str:
    """A tokenizer file's content, if it is of the kind that is encoded here."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    given = json.loads(content)
    words, model = given.get("pre_tokenizer") or {}, given["model"]
    plain = (
        given.get("normalizer") is None
        and words.get("type") == "ByteLevel"
        and words.get("use_regex", True)
        and not words.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(
            model.get(option)
            for option in (
                "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                "ignore_merges",
            )
        )
        and not any(
            token[option]
            for token in given["added_tokens"]
            for option in ("single_word", "lstrip", "rstrip", "normalized")
        )
    )
    if not plain:
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    return content


def _encode_rows(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in batches:
        texts, ids, first = batch.column("_text"), [], 0
        size = 0
        for i in range(len(texts)):
            ids.append(np.array(coder.encode_text(texts[i].as_py()), np.int32))
            size += len(ids[-1])
            if size >= _BATCH_TOKENS or i == len(texts) - 1:
                rows = batch.column("_row").slice(first, len(ids))
                yield pa.record_batch([rows, _lists(ids)], ["_row", "ids"])
                ids, first, size = [], i + 1, 0


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(values))


def _cut_rows(
    batches: Iterator[pa.RecordBatch], vocabulary, size: int
) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in batches:
        for i in range(len(batch)):
            pieces = coder.cuts(batch.column("_text")[i].as_py(), size)
            n = len(pieces)
            yield pa.record_batch(
                [
                    pa.array([batch.column("_id")[i].as_py()] * n, pa.int64()),
                    pa.array(range(n), pa.int32()),
                    batch.column("_row").take(pa.array([i] * n)),
                    pa.array(pieces, pa.string()),
                ],
                ["_id", "_piece", "_row", "_text"],
            )


def _encode_pieces(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in batches:
        for i in range(len(batch)):
            found = coder.encode_piece(batch.column("_text")[i].as_py())
            yield pa.record_batch(
                [
                    *[batch.column(c).slice(i, 1) for c in ("_id", "_piece", "_row")],
                    pa.array([found.ids.tobytes()], pa.binary()),
                    pa.array([found.heads.tobytes()], pa.binary()),
                ],
                ["_id", "_piece", "_row", "ids", "heads"],
            )


def _join_pieces(table: pa.Table, vocabulary) -> pa.Table:
    coder = _coder(vocabulary.value)
    table = table.sort_by("_piece")
    parts = [
        Encoded(np.frombuffer(ids.as_py(), np.int32), np.frombuffer(heads.as_py(), bool))
        for ids, heads in zip(table.column("ids"), table.column("heads"))
    ]
    whole = coder.join_all(parts)
    return pa.table({"_row": table.column("_row").slice(0, 1), "ids": _lists([whole.ids])})


def _decode_rows(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in batches:
        ids = batch.column("_ids")
        texts = [coder.decode_ids(ids[i].values.to_numpy().tolist()) for i in range(len(ids))]
        yield pa.record_batch(
            [batch.column("_row"), pa.array(texts, pa.string())], ["_row", "text"]
        )
