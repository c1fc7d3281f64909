"""Secrets in texts, found through an inverted index of trigrams.

Each rule's pattern is turned into a Boolean query over trigrams that any match must contain.
Texts come in segments (runs of an Arrow batch); a segment's index lists, for each trigram that
some rule asks for, the texts that hold it. A rule's candidates are what its query leaves when
postings are intersected and united, and only they are searched. A rule whose pattern demands no
trigram searches every text. Segments stay where their texts are, so no text is shuffled.
"""

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as c
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybook.llm.arrays import Texts, lower_ascii, text_slices

_MOST_STRINGS = 64
_MOST_CHOICES = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and how long its match (or a group of it) has to be."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6, group=2, ignore_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # A greedy run from its leftmost start: the same spans as runs of any length, kept from 24 on.
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# A query is True (any text), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def trigram_query(rule: Rule) -> Query:
    """The trigrams, lower-cased, that every match of the rule contains."""
    strings, query = _analyse(parser.parse(rule.pattern))
    return _and([query, _of_strings(strings)])


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES
) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start and end (code points, end exclusive) of each find.

    Matches of one rule are leftmost and do not overlap; those of different rules may. Spans are
    sorted by start, then in the order of the rules. Null and empty texts have none, equal rows
    are searched alike, an empty table gives no rows and other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rules = tuple(rules)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(rules)
        for batch in batches:
            for texts in text_slices(batch.column("text")):
                ids = batch.column("doc_id").slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, searcher.spans(texts)], names=["doc_id", "spans"]
                )

    return docs.select("doc_id", "text").mapInArrow(
        search,
        f"doc_id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>",
    )


class _Searcher:
    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = [(rule, trigram_query(rule), rule.compiled()) for rule in rules]
        asked = sorted(set().union(*[_trigrams(query) for _, query, _ in self.rules]))
        self.codes = np.array([int.from_bytes(t, "big") for t in asked], np.int32)
        self.asked = asked
        self.number = np.full(1 << 24, -1, np.int16)
        self.number[self.codes] = np.arange(len(asked))
        self.lower = lower_ascii()

    def spans(self, texts: Texts) -> pa.Array:
        everything = np.arange(len(texts))
        postings = self.index(texts)
        found: list[list[tuple]] = [[] for _ in everything]
        decoded: dict[int, str] = {}
        for order, (rule, query, pattern) in enumerate(self.rules):
            for i in _candidates(query, postings, everything):
                if i not in decoded:
                    part = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
                    decoded[i] = part.tobytes().decode()
                for match in pattern.finditer(decoded[i]):
                    if len(match[rule.group]) >= rule.least:
                        found[i].append((match.start(), order, match.end()))
        rows = [
            [
                {"kind": self.rules[order][0].kind, "start": start, "end": end}
                for start, order, end in sorted(spans)
            ]
            for spans in found
        ]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.list_(kind))

    def index(self, texts: Texts) -> dict[bytes, np.ndarray]:
        """The sorted texts that hold each trigram that is asked for."""
        data = self.lower[texts.data].astype(np.int32)
        if len(data) < 3 or not len(self.asked):
            return {}
        number = self.number[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(number >= 0)
        text = np.searchsorted(texts.offsets, at, "right") - 1
        whole = at + 3 <= texts.offsets[text + 1]
        pairs = np.unique(number[at[whole]].astype(np.int64) * len(texts) + text[whole])
        cuts = np.searchsorted(pairs, np.arange(len(self.asked) + 1) * len(texts))
        return {
            trigram: pairs[cuts[k] : cuts[k + 1]] - k * len(texts)
            for k, trigram in enumerate(self.asked)
        }


def _candidates(query: Query, postings: dict, everything: np.ndarray) -> np.ndarray:
    if query is True:
        return everything
    if isinstance(query, bytes):
        return postings.get(query, everything[:0])
    kind, parts = query
    lists = sorted((_candidates(p, postings, everything) for p in parts), key=len)
    merged = lists[0]
    for other in lists[1:]:
        if kind == "and":
            merged = np.intersect1d(merged, other, assume_unique=True)
        else:
            merged = np.union1d(merged, other)
    return merged


def _trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(_trigrams, query[1])) if isinstance(query, tuple) else set()


def _and(queries: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(queries: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """A match contains one of the strings, hence all trigrams of one of them."""
    encoded = [s.encode() for s in sorted(strings)]
    return _or([_and([e[i : i + 3] for i in range(len(e) - 2)]) for e in encoded])


def _analyse(nodes) -> tuple[set[str], Query]:
    """What the nodes match: a query, and then one of a few strings that follow each other."""
    strings, query = {""}, True
    for op, value in nodes:
        choices, needed = _choices(op, value)
        if choices is not None and len(strings) * len(choices) <= _MOST_STRINGS:
            strings = {a + b for a, b in product(strings, choices)}
        else:
            query = _and([query, _of_strings(strings), _of_strings(choices or {""})])
            strings = {""}
        query = _and([query, needed])
    return strings, query


def _choices(op, value) -> tuple[set[str] | None, Query]:
    """The strings a node can match, None where they are too many; and what it needs besides."""
    if op is c.LITERAL:
        return {chr(value).lower()}, True
    if op is c.IN and all(kind is c.LITERAL for kind, _ in value) and len(value) <= _MOST_CHOICES:
        return {chr(code).lower() for _, code in value}, True
    if op is c.SUBPATTERN:
        return _part(value[3])
    if op is c.BRANCH:
        parts = [_part(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*[strings for strings, _ in parts]), True
        return None, _or([_and([q, _of_strings(s or {""})]) for s, q in parts])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, inner = value
        strings, needed = _part(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, True
        if least:
            return None, _and([needed, _of_strings(strings or {""})])
    return None, True


def _part(nodes) -> tuple[set[str] | None, Query]:
    strings, query = _analyse(nodes)
    # Only strings that are all of the match can be joined to what stands beside them.
    plain = query is True and all(_choices(op, value)[0] is not None for op, value in nodes)
    return (strings, True) if plain else (None, _and([query, _of_strings(strings)]))
