"""Operator 3: secret scans through a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived (sets of
strings that a match must contain, joined by AND and OR). Per batch of texts an
inverted index holds, for the trigrams that some rule asks for, which texts have
them. Postings are intersected, and only the candidates are verified with the
pattern itself. A rule whose query is always true (no mandatory trigram) scans
every text. The index is over text with A-Z folded, so a query can only admit
too many texts, never too few.

Edge cases: a null text counts as empty and has no spans; repeated rows give
repeated results; empty table, empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as sre

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.arrow import map_batches, texts

#: Most strings of an exact set, and most members of a character class in it.
MOST_STRINGS, MOST_CLASS = 128, 8
#: Bytes of text indexed at once.
PIECE = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if its group has the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = 0


#: The base rules (fixed values of the contract).
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.IGNORECASE | re.ASCII),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Published shapes of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: True, or an OR (frozenset) of ANDs (frozensets of trigrams).
Query = bool | frozenset


def _any_of(strings: set[bytes]) -> Query:
    ands = set()
    for s in strings:
        if len(s) < 3:
            return True
        ands.add(frozenset(s[i : i + 3] for i in range(len(s) - 2)))
    return frozenset(a for a in ands if not any(b < a for b in ands))


def _both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return frozenset(x | y for x in a for y in b)


def _either(queries: list[Query]) -> Query:
    return True if any(q is True for q in queries) else frozenset().union(*queries)


def _cross(a: set[bytes], b: set[bytes]) -> set[bytes] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MOST_STRINGS else None


def _members(items: list) -> set[bytes] | None:
    found: set[bytes] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value).encode().lower())
        elif kind is C.RANGE and value[1] - value[0] < MOST_CLASS:
            found |= {chr(c).encode().lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CLASS else None


def _sequence(nodes) -> tuple[set[bytes] | None, Query]:
    """The strings that match exactly, if few; and what any match must contain."""
    query: Query = True
    now: set[bytes] = {b""}
    whole = True

    def end(more: Query = True) -> None:
        nonlocal query, now, whole
        query, now, whole = _both(_both(query, _any_of(now)), more), {b""}, False

    for kind, value in nodes:
        exact, inner, open_end = None, True, False
        if kind is C.LITERAL:
            exact = {chr(value).encode().lower()}
        elif kind is C.IN:
            exact = _members(value)
        elif kind is C.SUBPATTERN:
            exact, inner = _sequence(value[3])
        elif kind is C.BRANCH:
            parts = [_sequence(p) for p in value[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            inner = _either([q if e is None else _any_of(e) for e, q in parts])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            one, one_query = _sequence(body)
            if low == 0:
                exact = {b""} | one if one is not None and high == 1 else None
            else:
                inner, exact, open_end = one_query, one, high != low
                for _ in range(min(low, 8) - 1):
                    exact = _cross(exact, one) if exact is not None else None
                open_end |= low > 8
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        joined = _cross(now, exact) if exact is not None else None
        if joined is None:
            end(inner)
            now = exact if exact is not None else {b""}
        else:
            now = joined
        if open_end:
            end()
    if whole:
        return now, _any_of(now)
    return None, _both(query, _any_of(now))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What the folded text must contain for ``pattern`` to match at all."""
    return _sequence(sre.parse(pattern, flags))[1]


class Index:
    """An inverted index of one batch over the trigrams that queries ask for."""

    def __init__(self, queries: list[Query]) -> None:
        asked = sorted({t for q in queries if q is not True for a in q for t in a})
        self.row = {t: i for i, t in enumerate(asked)}
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        for t, i in self.row.items():
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, folded: list[bytes]) -> np.ndarray:
        """For each trigram a row that tells which texts have it."""
        found = np.zeros((len(self.row), len(folded)), dtype=bool)
        starts = np.cumsum([0] + [len(t) for t in folded])
        data = np.frombuffer(b"".join(folded), dtype=np.uint8)
        for lo in range(0, max(len(data) - 2, 0), PIECE):
            part = data[lo : lo + PIECE + 2].astype(np.uint32)
            rows = self.slot[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(rows >= 0)
            found[rows[at], np.searchsorted(starts, at + lo, "right") - 1] = True
        return found

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        """Numbers of the texts that satisfy ``query``."""
        if query is True:
            return np.arange(postings.shape[1])
        hit = np.zeros(postings.shape[1], dtype=bool)
        for conjunction in query:
            hit |= np.logical_and.reduce([postings[self.row[t]] for t in conjunction])
        return np.flatnonzero(hit)


class Scanner:
    """Compiled rules, their queries, and the index that serves them."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.index = Index([q for _, _, q in self.rules])

    def scan(self, found: list[str]) -> list[list[dict]]:
        """Spans of each text by start, then by the order of the rules."""
        postings = self.index.postings([t.encode("utf-8", "surrogatepass").lower() for t in found])
        spans: list[list[tuple]] = [[] for _ in found]
        for place, (rule, pattern, query) in enumerate(self.rules):
            for i in self.index.candidates(query, postings):
                for m in pattern.finditer(found[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        spans[i].append((m.start(), place, m.end(), rule.kind))
        return [[{"kind": k, "start": a, "end": b} for a, _, b, k in sorted(s)] for s in spans]


_SCANNERS: dict[tuple, Scanner] = {}


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end) in code points."""

    def scan(batch):
        if rules not in _SCANNERS:
            _SCANNERS[rules] = Scanner(rules)
        return {"doc_id": batch.column("doc_id"), "spans": _SCANNERS[rules].scan(batch.column("text").to_pylist())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(texts(df, id_col, text_col), scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
