"""Conversations to marked-up training texts, and back.

A turn becomes ``<s>[INST]role[/INST]text</s>``. Control strings inside a role or text are kept
apart by a backslash after their first character; one that already has backslashes there gets one
more, so that taking one away restores every text.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallybook.llm.arrays import text_slices

_REST = r"(/?s>|/?INST\])"
_CONTROL = re.compile(r"([<\[])(\\*)" + _REST)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _REST)
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)

LOSS_ROLE = "assistant"
PART_BYTES = 8 << 20
_SORTED = "conv_id", "turn", "role", "text"
_FORMATTED = "conv_id", "part", "formatted", "loss"
_DIGEST = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_conversations(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per conversation: ``conv_id, part, formatted`` and ``loss``, the code point spans
    of what the assistant says, as ``(start, length)``.

    Turns go by number, equal ones by role and text; a repeated row is a repeated turn. A null
    text or role is empty, a null id is an id like others, an empty table gives no rows and other
    columns are not read. A conversation of more than ``part_bytes`` goes on in further parts,
    whose texts follow each other; so a task holds one part, however long a conversation is.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    turns = (
        conversations.select(*_SORTED).repartition("conv_id").sortWithinPartitions(*_SORTED)
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, parts, rows in _conversations(batches, part_bytes):
            yield _assembled(heads, parts, rows)

    return turns.mapInArrow(
        assemble,
        f"conv_id {id_type}, part int, formatted string,"
        " loss array<struct<start: bigint, length: bigint>>",
    )


def _conversations(
    batches: Iterator[pa.RecordBatch], part_bytes: int
) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Runs of turns that hold whole conversations or a part of one: where each conversation
    begins, the number of its part, and the turns."""
    waiting: list[pa.RecordBatch] = []
    key: object = None
    part = 0
    held = 0

    def take(rows: pa.RecordBatch, first_part: int):
        heads = np.flatnonzero(np.diff(_codes(rows.column(0)), prepend=-1))
        parts = np.zeros(len(heads), np.int32)
        parts[0] = first_part
        return heads, parts, rows

    for batch in batches:
        for piece in text_slices(batch.column("text")):
            rows = batch.slice(piece.first, len(piece))
            if not rows.num_rows:
                continue
            ids = rows.column(0)
            # Rows up to the last change of the id are complete; the rest may go on.
            codes = _codes(ids)
            changes = np.flatnonzero(np.diff(codes)) + 1
            if ids[0].as_py() != key:
                if waiting:
                    yield take(_joined(waiting), part)
                waiting, part, held = [], 0, 0
            if len(changes):
                yield take(_joined([*waiting, rows.slice(0, changes[-1])]), part)
                waiting, part, held = [], 0, 0
                rows = rows.slice(changes[-1])
            waiting.append(rows)
            key = ids[len(ids) - 1].as_py()
            held += len(piece.data)
            if held > part_bytes:
                yield take(_joined(waiting), part)
                waiting, part, held = [], part + 1, 0
    if waiting:
        yield take(_joined(waiting), part)


def _codes(ids: pa.Array) -> np.ndarray:
    return ids.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return rows[0] if len(rows) == 1 else pa.concat_batches(rows)


def _assembled(heads: np.ndarray, parts: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
    """Headers, texts and trailers of all turns, copied at once into one buffer."""
    roles = rows.column("role").fill_null("").dictionary_encode()
    names = roles.dictionary.to_pylist()
    headers = [f"<s>[INST]{escape(name)}[/INST]".encode() for name in names]
    trailer = b"</s>"
    texts = _escaped(rows.column("text").fill_null("")).cast(pa.large_binary())
    text_at = np.frombuffer(texts.buffers()[1], np.int64)
    text_at = text_at[texts.offset : texts.offset + len(texts) + 1]
    table = b"".join(headers) + trailer
    held = texts.buffers()[2] or b""
    body = np.frombuffer(held, np.uint8)[text_at[0] : text_at[-1]]
    source = np.concatenate([np.frombuffer(table, np.uint8), body])

    role = roles.indices.to_numpy()
    header_size = np.array([len(h) for h in headers], np.int64)
    header_at = np.cumsum(header_size) - header_size
    sizes = np.empty((len(texts), 3), np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2] = header_size[role], np.diff(text_at), len(trailer)
    begins = np.empty_like(sizes)
    begins[:, 0] = header_at[role]
    begins[:, 1] = text_at[:-1] - text_at[0] + len(table)
    begins[:, 2] = len(table) - len(trailer)

    ends = np.cumsum(sizes)
    places = ends - sizes.ravel()
    total = int(ends[-1])
    gather = np.repeat(begins.ravel() - places, sizes.ravel())
    gather += np.arange(total)
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    np.take(source, gather, out=out)

    offsets = np.append(places[heads * 3], total)
    # Code points before each byte: every byte counts that does not continue a character.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    of_turn = np.searchsorted(heads, np.arange(len(texts)), "right") - 1
    lossy = np.flatnonzero(np.array([name == LOSS_ROLE for name in names])[role])
    text_place = places[1::3]
    start = points[text_place] - points[offsets[of_turn]]
    length = points[ends[1::3]] - points[text_place]
    spans = pa.StructArray.from_arrays(
        [pa.array(start[lossy]), pa.array(length[lossy])], ["start", "length"]
    )
    span_at = np.searchsorted(of_turn[lossy], np.arange(len(heads) + 1)).astype(np.int32)
    formatted = pa.StringArray.from_buffers(
        len(heads), pa.py_buffer(offsets.astype(np.int32)), buffer
    )
    return pa.RecordBatch.from_arrays(
        [
            rows.column("conv_id").take(pa.array(heads)),
            pa.array(parts),
            formatted,
            pa.ListArray.from_arrays(pa.array(span_at), spans),
        ],
        names=_FORMATTED,
    )


def _escaped(texts: pa.Array) -> pa.Array:
    hit = pc.match_substring_regex(texts, _CONTROL.pattern)
    if not pc.any(hit).as_py():
        return texts
    replaced = [escape(t) for t in texts.filter(hit).to_pylist()]
    return pc.replace_with_mask(texts, hit, pa.array(replaced, texts.type))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, from its formatted text and loss spans alone.

    Rows may come in any order, as from a stored table: parts are gathered by conversation, and
    unless a conversation has the parts 0, 1, 2, ... once each, the job fails. Per conversation:
    number of turns, SHA-256 of role, line feed, text and line feed of every turn, length and
    SHA-256 of the text under the loss spans, and length of the formatted text; lengths in code
    points, texts unescaped.
    """
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    formatted = (
        formatted.select(*_FORMATTED)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: _Digest | None = None
        for batch in batches:
            done = []
            rows = zip(*[batch.column(c).to_pylist() for c in _FORMATTED])
            for conv_id, part, text, loss in rows:
                if open_one is None or open_one.conv_id != conv_id:
                    if open_one is not None:
                        done.append(open_one.row())
                    open_one = _Digest(conv_id)
                open_one.add(part, text, loss)
            if done:
                yield _digest_batch(done, batch.schema.field("conv_id").type)
        if open_one is not None:
            yield _digest_batch([open_one.row()], batch.schema.field("conv_id").type)

    return formatted.mapInArrow(digest, f"conv_id {id_type}, {_DIGEST}")


class _Digest:
    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.n_turns = self.loss_chars = self.chars = self.parts = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, part: int, text: str, loss: list[dict]) -> None:
        if part != self.parts:
            raise ValueError(f"conversation {self.conv_id}: part {part} in the place of {self.parts}")
        self.parts += 1
        self.chars += len(text)
        at = 0
        for turn in _TURN.finditer(text):
            if turn.start() != at:
                break
            at = turn.end()
            role, said = unescape(turn[1]), unescape(turn[2])
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        if at != len(text):
            raise ValueError(f"conversation {self.conv_id}: no turn at code point {at}")
        for span in loss:
            said = unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)

    def row(self) -> tuple:
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars,
            self.loss.hexdigest(), self.chars,
        )


def _digest_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
    ]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=names)
