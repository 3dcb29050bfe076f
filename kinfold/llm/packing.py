"""Operator 2: packing token sequences by first-fit decreasing.

Documents are dealt at random into groups, and each group is packed on its own:
pieces in decreasing length, each into the first bin that has room. A tournament
tree over the bins' free space finds that bin in logarithmic time. Documents are
cut at multiples of the bin size first, so whole bins need no search.

What stays free afterwards is closed by cutting: the emptiest bin's tail moves
into the gaps of fuller ones, and the one bin that is left partly filled is cut
into bins whose lengths are powers of two, which need no padding.

Edge cases: a null text counts as empty and packs its end id alone; repeated
rows are packed each for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.arrow import map_batches, texts
from kinfold.llm.tokens import CACHE_CHARS, Splitter

#: Documents of a group on average.
GROUP = 512
#: Pretokens whose identifiers a worker remembers.
CACHE = 800_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder(dict):
    """Identifiers of texts by the library, remembered by pretoken."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_padding()
        self.tool.no_truncation()
        added = self.tool.get_added_tokens_decoder().values()
        self.split = Splitter([t.content for t in added], path)
        self.kind = np.dtype("<u2" if self.tool.get_vocab_size() <= 1 << 16 else "<u4")  # also the array type of that size

    def __missing__(self, word: str) -> bytes:
        ids = array(self.kind.char, self.tool.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The identifiers of a whole text."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), dtype=self.kind)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Tournament:
    """Free space of bins in a binary tree whose nodes hold the larger child."""

    def __init__(self, bins: int, size: int) -> None:
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.best = [size] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with ``need`` free."""
        node, best, leaves = 1, self.best, self.leaves
        while node < leaves:
            node *= 2
            if best[node] < need:
                node += 1
        return node - leaves

    def take(self, place: int, need: int) -> None:
        """Use ``need`` of a bin and replay its matches."""
        node, best = place + self.leaves, self.best
        best[node] -= need
        while node > 1:
            node //= 2
            new = max(best[2 * node], best[2 * node + 1])
            if best[node] == new:
                return
            best[node] = new


def first_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers for lengths in decreasing order, none above ``size``."""
    tree, bins = Tournament(len(lengths), size), []
    for item, need in enumerate(lengths):
        place = tree.first(need)
        tree.take(place, need)
        if place == len(bins):
            bins.append([])
        bins[place].append(item)
    return bins


def closed(bins: list[list[int]], lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) after cutting has closed all gaps."""
    cut = [[(i, 0, lengths[i]) for i in b] for b in bins]
    used = [sum(lengths[i] for i in b) for b in bins]
    order = sorted(range(len(cut)), key=lambda b: -used[b])
    front, back = 0, len(order) - 1
    while front < back:
        to, donor = order[front], order[back]
        if used[to] == size:
            front += 1
        elif not used[donor]:
            back -= 1
        else:
            item, start, length = cut[donor].pop()
            moved = min(length, size - used[to])
            if moved < length:
                cut[donor].append((item, start, length - moved))
            cut[to].append((item, start + length - moved, moved))
            used[to] += moved
            used[donor] -= moved
    full = [cut[b] for b in order if used[b] == size]
    for b in order:
        if 0 < used[b] < size:
            full += powers(cut[b], used[b])
    return full


def powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of one bin, cut into bins whose lengths are powers of two."""
    out, left = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            room, own = 1 << bit, []
            while room:
                item, start, length = left.pop(0)
                part = min(length, room)
                own.append((item, start, part))
                if part < length:
                    left.insert(0, (item, start + part, length - part))
                room -= part
            out.append(own)
    return out


def pack(df: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, group: int = GROUP, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``ids`` also the identifiers of the piece. One shuffle by group; whole
    bins travel without their identifiers unless these are asked for.
    """
    groups = max(1, -(-df.count() // group))
    crc = lambda a: zlib.crc32(a.astype("<u4").tobytes())

    def encode(batch):
        tool = encoder(vocabulary)
        out: dict[str, list] = {c: [] for c in ("doc_id", "grp", "start", "length", "ids_crc32", "doc_tokens", "data")}
        for i, text, seed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "seed")), strict=True):
            found = np.append(tool.encode(text), np.array([end_id], dtype=tool.kind))
            for start in range(0, len(found), size):
                part = found[start : start + size]
                whole = len(part) == size
                out["doc_id"].append(i)
                out["grp"].append((seed + start // size * 0x9E3779B1) % groups)
                out["start"].append(start)
                out["length"].append(len(part))
                out["ids_crc32"].append(crc(part))
                out["doc_tokens"].append(len(found))
                out["data"].append(part.astype("<u4").tobytes() if ids or not whole else b"")
        step = 4096
        for lo in range(0, len(out["doc_id"]), step):
            yield {c: v[lo : lo + step] for c, v in out.items()}

    dealt = texts(df, id_col, text_col).withColumn("seed", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    pieces = map_batches(dealt, encode, "doc_id long, grp long, start long, length long, ids_crc32 long, doc_tokens long, data binary")
    schema = SCHEMA + ", ids array<int>" * ids

    def fit(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        rows = sorted(range(table.num_rows), key=lambda r: (-columns["length"][r], -1 if columns["doc_id"][r] is None else columns["doc_id"][r], columns["start"][r], columns["ids_crc32"][r]))
        lengths = [columns["length"][r] for r in rows]
        data = [np.frombuffer(columns["data"][r], dtype="<u4") for r in rows]
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for number, content in enumerate(closed(first_fit(lengths, size), lengths, size)):
            offset = 0
            for item, start, length in content:
                r, cut = rows[item], length < lengths[item]
                values = (columns["doc_id"][r], columns["start"][r] + start, length, crc(data[item][start : start + length]) if cut else columns["ids_crc32"][r], columns["doc_tokens"][r], columns["grp"][r] << 32 | number, offset)
                for c, v in zip(out, values, strict=False):
                    out[c].append(v)
                if ids:
                    out["ids"].append(data[item][start : start + length].astype(np.int32))
                offset += length
        kinds = {c: pa.int64() for c in out} | ({"ids": pa.list_(pa.int32())} if ids else {})
        return pa.table({c: pa.array(v, type=kinds[c]) for c, v in out.items()})

    return pieces.groupBy("grp").applyInArrow(fit, schema)
