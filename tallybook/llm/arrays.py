"""Texts of an Arrow column as byte arrays: slices of bounded size, words and their hashes."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
# For work whose arrays are many times as long as the text: they then stay in the CPU's cache too.
SMALL_SLICE_BYTES = 1 << 19
_CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie in the ranges (both ends included)."""
    chosen = np.zeros(256, bool)
    for low, high in ranges:
        chosen[low : high + 1] = True
    return chosen


# Words are runs of bytes outside the separators; UTF-8 bytes over 0x7F never separate.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = ~byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def lower_ascii() -> np.ndarray:
    """A table of bytes that lower-cases A to Z."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64) -> np.ndarray:
    powers = np.full(_CHUNK + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = lower_ascii()
_LOWER_VALUES = _VALUES[_LOWER]


@dataclass
class Texts:
    """Some texts as one run of bytes; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column, null as empty, in slices of about ``limit`` bytes.

    A text is never cut: one that is longer makes a slice of its own.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held or b"", np.uint8)
    first = 0
    while first < len(column):
        after = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        after = min(max(after, first + 1), len(column))
        begin, end = offsets[first], offsets[after]
        yield Texts(first, data[begin:end], offsets[first : after + 1] - begin)
        first = after


def runs(
    data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of chosen bytes, none across two texts."""
    inside = chosen[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    tails = heads[heads > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True
) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by its content alone; starts and ends are sorted."""
    return many_span_hashes(data, [(starts, ends)], lower)[0]


def many_span_hashes(
    data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], lower: bool = True
) -> list[np.ndarray]:
    """Hashes of several lists of spans, as ``span_hashes`` has them, in one pass.

    Differences of running sums of a polynomial, in chunks, so that the working memory does not
    grow with the text.
    """
    values = _LOWER_VALUES if lower else _VALUES
    sums_at = [(np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)) for s, _ in spans]
    shifts = [np.ones(len(s), np.uint64) for s, _ in spans]
    carried, up, down = np.uint64(0), np.uint64(1), np.uint64(1)
    with np.errstate(over="ignore"):
        for base in range(0, max(len(data), 1), _CHUNK):
            chunk = data[base : base + _CHUNK]
            sums = np.empty(len(chunk) + 1, np.uint64)
            sums[0] = carried
            np.cumsum(values[chunk] * _UP[: len(chunk)] * up, out=sums[1:])
            sums[1:] += carried
            for (starts, ends), (at_start, at_end), shift in zip(spans, sums_at, shifts):
                a, b = np.searchsorted(starts, (base, base + _CHUNK))
                local = starts[a:b] - base
                at_start[a:b] = sums[local]
                shift[a:b] = _DOWN[local] * down
                a, b = np.searchsorted(ends, (base, base + _CHUNK), "right")
                at_end[a:b] = sums[ends[a:b] - base]
            carried = sums[-1]
            up, down = up * _UP[_CHUNK], down * _DOWN[_CHUNK]
        return [
            mix((at_end - at_start) * shift + (ends - starts).astype(np.uint64))
            for (starts, ends), (at_start, at_end), shift in zip(spans, sums_at, shifts)
        ]


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0
) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case, that no pattern of letters defeats.

    Every eight bytes are mixed with their place and the seed before they are added up, so hashes of
    two seeds are independent. Works through a long word in pieces.
    """
    plain = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(plain, 8)
    lengths = ends - starts
    blocks = (lengths + 7) >> 3
    after = np.cumsum(blocks)
    total = int(after[-1]) if len(after) else 0
    sums = np.zeros(len(starts), np.uint64)
    salt = mix(np.array([seed + 1], np.uint64) * _BASE)
    for first in range(0, total, _CHUNK):
        number = np.arange(first, min(first + _CHUNK, total))
        word = np.searchsorted(after, number, "right")
        place = number - (after[word] - blocks[word])
        at = starts[word] + 8 * place
        value = np.ascontiguousarray(eights[at]).view("<u8").ravel()
        missing = np.maximum(8 * place + 8 - lengths[word], 0).astype(np.uint64) << np.uint64(3)
        value &= ~np.uint64(0) >> missing
        value = mix(value ^ mix((place.astype(np.uint64) + np.uint64(1)) * _INVERSE + salt))
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        sums[word[heads]] += np.add.reduceat(value, heads)
    return mix(sums + lengths.astype(np.uint64) * _BASE + salt)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    count = len(words) - n + 1
    grams = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            grams = mix(grams * _BASE + words[i : i + count])
    return grams
