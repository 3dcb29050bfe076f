"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

Each pretoken starts as its UTF-8 bytes. A heap holds the adjacent pairs that
the vocabulary can merge, lowest rank first; a doubly linked list tells what is
adjacent after a merge. The count is the number of initial symbols minus the
number of merges, so no token identifier is ever made.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated results; an empty table gives an empty result; columns besides the
identifier and the text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame

from kinfold.llm.arrow import map_batches, texts

#: The published split pattern of byte-level vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts below U+0250, whose letters, numbers and spaces these are.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN_SPLIT = rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
#: Remembered pretokens of one worker, and the longest one that is remembered.
CACHE, CACHE_CHARS = 300_000, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, by the published rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Splitter:
    """Cuts texts into pretokens as the library does, special strings first."""

    def __init__(self, specials: list[str], path: str) -> None:
        self.specials, self.path = set(specials), path
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.plain = regex.compile(SPLIT)
        self.latin, self.beyond = re.compile(LATIN_SPLIT), re.compile("[ɐ-\U0010ffff]")
        self.exact = None

    def _find(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.latin.findall(text)
        if all(unicodedata.category(c) != "Cn" for c in set(text)):
            return self.plain.findall(text)
        if self.exact is None:  # characters that the two libraries' Unicode tables may class differently
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.exact.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.specials):
            return self._find(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.specials else self._find(part))]


class PairMerger(dict):
    """Token counts of pretokens, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = [vocab[s] for s in byte_symbols()]
        self.rule = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rule[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.split = Splitter([t["content"] for t in spec["added_tokens"]], path)

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.split.specials else self.merged(word.encode("utf-8", "surrogatepass"))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: bytes) -> int:
        """Symbols that are left of ``word`` when no pair can be merged."""
        rule, symbol, n = self.rule, [self.start[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := rule.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # an earlier merge took one of the two
            merges += 1
            symbol[i], symbol[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := rule.get((joined, symbol[k])):
                    heapq.heappush(heap, (found[0], i, joined, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := rule.get((symbol[h], joined))):
                heapq.heappush(heap, (found[0], h, symbol[h], joined, found[1]))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(map(self.__getitem__, self.split(text)))


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """This process's merger for a vocabulary file."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is a path that every executor has. A map without shuffle.
    """

    def count(batch):
        tool = merger(vocabulary)
        found = batch.column("text").to_pylist()
        n = [tool.count(t) for t in found]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in found], "n_tokens": n, "over_limit": [x > limit for x in n]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(texts(df, id_col, text_col), count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
