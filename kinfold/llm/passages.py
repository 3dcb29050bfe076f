"""Operator 8: repeated passages by paragraph MinHash banding.

A passage may sit anywhere inside other text, so paragraphs are content-defined:
UNIT words from each anchor, an anchor being the smallest hash in some window of
places. They are banded twice. By all their five-word shingles, which finds every
equal one, with windows of NEAR places: any 25 equal words have an anchor of their
own, and a passage of over 50 words keeps 25 equal words in a row at similarity 0.8
(one word in the middle of 51 changed leaves 25, more changes need a longer text).
By two MinHash rows, with windows of WINDOW places, which finds changed paragraphs
too. One row alone would fill buckets with all that share a frequent phrase.
A paragraph that collides with another document's is joined to the first of its
bucket, and to the first of those in the bucket that also agree in the CONTEXT words
before it, after it, or both: documents that share a passage around a frequent line
meet whoever holds the line first. Every place of a paragraph is joined; those in the
first document go to the next document's first.

Each paragraph that two documents have in common is verified on hashes of the words
themselves, unless another has led there: both texts are followed to both sides over
equal words and over gaps of up to GAP substituted, inserted or deleted words, and
the longest stretches count that have over 50 words on both sides and an exact
Jaccard similarity of at least 0.8. Overlapping spans of a document are one instance, and connected components over instances give the
clusters, of which all but the first are to be removed.

Keys that stand in more than one in HEAVY documents are dealt over tasks by
document; the firsts of each task's share then meet in the same way.

Edge cases: null and empty texts and rows without doc_id have no passages; rows
that share a doc_id are one document with several texts, each searched whole;
repeats within one document do not count; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.llm.arrow import bounded_batches, map_batches, texts, whole_groups
from kinfold.operators.components import connected_components
from kinfold.operators.storage import discard, scoped, written

UNIT, WINDOW, NEAR, SHINGLE = 15, 36, 11, 5
#: MinHash rows of each band, 0 standing for all shingles in order, and its windows.
BANDS = ((0, NEAR), (2, WINDOW))
#: Words beside a paragraph; 51 words have an anchor with these after it (or before).
CONTEXT = 51 - NEAR + 1 - UNIT
#: A passage has at least so many words and so similar shingles.
LEAST_WORDS, SIMILARITY = 51, 0.8
#: Words that may differ in one place, and equal words that end such a gap.
GAP, RESUME = 24, 3
MARGIN = LEAST_WORDS + GAP
#: A key of more than one in HEAVY of the sampled documents (one in SAMPLE) is dealt
#: over SALTS tasks.
HEAVY, SAMPLE, SALTS = 256, 32, 64
#: What rows of one key may agree in besides, to meet a first of their own.
GROUPS = ((), (0,), (1,), (0, 1))  # of the words before and after
#: Paragraphs of a pair that are verified together.
CELL = 4096
MET_ROW = "kind int, key long, src long, stid int, pos int, dst long, dtid int, there int"
KEY_ROW = "key long, salt int, doc_id long, tid int, pos int, before int, after int"
SPAN_ROW = "src long, stid int, start int, end int, dst long, dtid int, dst_start int, dst_end int"
SPAN_NAMES = tuple(x.split()[0] for x in SPAN_ROW.split(", "))
KEY_NAMES = tuple(x.split()[0] for x in KEY_ROW.split(", "))


def words_of(text: str) -> list[bytes]:
    """Words with A-Z folded, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


#: Powers of an odd number and of its inverse, and a random number for each byte.
_BASE, _POWERS = 0xD6E8FEB86659FD93, [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = _mix(np.arange(256, dtype=np.uint64), 77)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[65:91] = _BYTES[97:123]  # A-Z fold
#: Bytes hashed at a time.
CHUNK = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            old = _POWERS[k]
            _POWERS[k] = np.concatenate([old, old * np.uint64(pow(base, len(old), 1 << 64))])
    return _POWERS


def _sums(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``x``, from prefix sums of x[k] * base ** k."""
    ahead, back = _powers(len(x) + 1)
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * ahead[: len(x)], out=total[1:])
    return (total[ends] - total[starts]) * back[starts]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 bytes, and where it begins."""
    found, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK:  # cut at a space
            gaps = np.flatnonzero(_SPACE[data[at + CHUNK :]][:CHUNK])
            end = at + CHUNK + int(gaps[0]) if len(gaps) else end
        part = data[at:end]
        space = np.ones(len(part) + 2, dtype=bool)
        space[1:-1] = _SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1])
        found.append(_mix(_sums(_BYTES[part], edges[::2], edges[1::2]), 5))
        places.append(edges[::2] + at)
        at = end
    return np.concatenate(found), np.concatenate(places)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (of ``words_of``)."""
    return _words(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))[0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word hashes."""
    count = max(len(words) - n + 1, 0)
    starts = np.arange(count)
    return _mix(_sums(words, starts, starts + n), n)


def paragraph_keys(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Band keys (signed) of texts, which text they are of and where their paragraphs
    begin there, and hashes of the CONTEXT words before and after them (fewer at the
    ends of the text)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = _words(np.frombuffer(b"\n".join(data), dtype=np.uint8))
    ends = np.cumsum([len(d) + 1 for d in data])
    owner = np.searchsorted(ends, places, side="right")
    number = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(number)])
    left = first[owner + 1] - np.arange(len(owner))  # words from here to the end of the text
    left[number[owner] < LEAST_WORDS] = 0
    order, shingles = grams(hashes, 3), grams(hashes, SHINGLE)
    keys, places_of = [], []
    for rows, window in BANDS:  # of all rows, that is every shingle, equal paragraphs alone collide
        whole = np.flatnonzero(left >= window - 1 + UNIT)
        at = np.unique(sliding_window_view(order, window)[whole].argmin(1) + whole) if len(whole) else whole
        least = np.zeros(len(at), dtype=np.uint64)
        if len(at):
            views = [sliding_window_view(_mix(shingles, 100 + row), UNIT - SHINGLE + 1)[at].min(1) for row in range(rows)]
            for row, view in enumerate(views or sliding_window_view(shingles, UNIT - SHINGLE + 1)[at].T):
                least = _mix(least ^ view, 50 + row)
        keys.append(_mix(least, 200 + rows))
        places_of.append(at)
    at = np.concatenate(places_of)
    own = owner[at]
    before = _mix(_sums(hashes, np.maximum(first[own], at - CONTEXT), at), CONTEXT)
    after = _mix(_sums(hashes, at + UNIT, np.minimum(first[own + 1], at + UNIT + CONTEXT)), CONTEXT)
    return np.concatenate(keys).view(np.int64), own, (at - first[own]).astype(np.int32), short(before).view(np.int32), short(after).view(np.int32)


def in_groups(texts: list[str]):
    """Ranges of texts of about CHUNK characters each."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK or k == len(texts) - 1:
            yield start, k + 1
            start, size = k + 1, 0


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of hashes."""
    return (hashes >> np.uint64(32)).astype("<u4")


def _keys(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(key, salt, doc_id, tid, pos, before, after): salt, which deals the keys in
    ``heavy`` (in order) over tasks and is 0 for others, is part of their key; tid
    tells the texts of a doc_id apart."""

    def make(batch):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        texts = batch.column("text").to_pylist()
        for low, high in in_groups(texts):
            key, own, pos, before, after = paragraph_keys(texts[low:high])
            doc = ids[low + own]
            tid = np.array([text_id(t) for t in texts[low:high]], dtype=np.int32)[own]
            salt = np.zeros(len(key), dtype=np.int32)
            if len(heavy):
                at = heavy[np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)] == key
                salt[at] = 1 + (_mix(doc[at].view(np.uint64), 3) % np.uint64(SALTS)).astype(np.int32)
                key[at] ^= _salted(salt[at])
            yield {n: pa.array(x) for n, x in zip(KEY_NAMES, (key, salt, doc, tid, pos, before, after), strict=True)}

    return map_batches(docs, make, KEY_ROW)


def _salted(salt: np.ndarray) -> np.ndarray:
    """What the keys of a salt are changed by."""
    return _mix(salt.astype(np.uint64), 9).view(np.int64)


def text_id(text: str) -> int:
    """A signed hash of a whole text."""
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 31)


def heavy_keys(docs: DataFrame) -> np.ndarray:
    """Keys of over one in HEAVY documents, in order, as one document in SAMPLE
    shows them: at most HEAVY times the mean of a document's keys. They tell only how
    rows are dealt over tasks; all keys of all documents are searched."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SAMPLE)) == 0)
    rows = written(_keys(some, np.empty(0, np.int64)).groupBy("key").agg(F.count_distinct("doc_id").alias("n")).where("n > 8"), "sampled-keys")
    least = max(8, some.count() // HEAVY)
    found = [r.key for r in rows.where(F.col("n") > least).collect()]
    discard(rows)
    return np.array(sorted(found), dtype=np.int64)


def _meet(groups: tuple):
    """Of rows in the order of keys: kind 0, a row with the first of its group,
    for each way of grouping; kind 1, the firsts of salted groups under a key of the
    group. The first itself is what others go to; its document's other places go on
    to the second, the first of another document."""

    def meet(batches):
        for batch, bounds in whole_groups(batches, ("key",)):
            doc = batch.column("doc_id").to_numpy()
            several = np.minimum.reduceat(doc, bounds[:-1]) < np.maximum.reduceat(doc, bounds[:-1])
            several |= batch.column("salt").to_numpy()[bounds[:-1]] > 0
            if not several.any():
                continue
            number = np.repeat(np.arange(len(several)), np.diff(bounds))
            kept = np.flatnonzero(several[number])
            number = number[kept]
            key, salt, doc, tid, pos, *around = (batch.column(c).to_numpy()[kept] for c in KEY_NAMES)
            left, right, firsts, names = [], [], [], []
            for level, chosen in enumerate(groups):
                own = [around[k] for k in chosen]
                order = np.lexsort((tid, pos, doc, *own, number))
                edge = np.zeros(len(order), dtype=bool)
                for column in (number, *own):
                    edge[1:] |= column[order][1:] != column[order][:-1]
                edge[0] = True
                start = np.flatnonzero(edge)
                group = np.cumsum(edge) - 1
                other = doc[order] != doc[order[start]][group]
                place = np.arange(len(order))
                second = np.minimum.reduceat(np.where(other, place, len(order)), start)
                to = np.where(other, start[group], np.where(edge, len(order), second[group]))
                goes = to < len(order)
                left.append(order[goes])
                right.append(order[to[goes]])
                if salt.any():
                    head = np.concatenate([start, second[second < len(order)]])
                    head = order[head[salt[order[head]] > 0]]
                    name = (key[head] ^ _salted(salt[head])).view(np.uint64)
                    for k in chosen:
                        name = _mix(name ^ around[k][head].astype(np.int64).view(np.uint64), 11 + k)
                    firsts.append(head)
                    names.append(_mix(name, 20 + level).view(np.int64))
            x, y = np.divmod(np.unique(np.concatenate(left) * len(doc) + np.concatenate(right)), len(doc))
            x, y = np.where(doc[x] > doc[y], x, y), np.where(doc[x] > doc[y], y, x)
            yield _met_batch(0, key[x], doc[x], tid[x], pos[x], doc[y], tid[y], pos[y])
            if firsts:
                z = np.concatenate(firsts)
                yield _met_batch(1, np.concatenate(names), doc[z], tid[z], pos[z], doc[z], tid[z], pos[z])

    return meet


def _met_batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *map(pa.array, columns)], names=[x.split()[0] for x in MET_ROW.split(", ")])


def candidates(docs: DataFrame) -> DataFrame:
    """(src, stid, dst, dtid, cell, shift, a, b, c, d, seeds): paragraphs of src from
    word a to b that may stand in dst from c to d, src the larger, those of CELL
    places together; a seed has both places in one number."""
    heavy = heavy_keys(docs)
    rows = bounded_batches(_keys(docs, heavy)).repartition("key").sortWithinPartitions("key")
    met = rows.mapInArrow(_meet(GROUPS), MET_ROW)
    if len(heavy):
        met = written(met, "met")
        again = met.where("kind = 1").select("key", F.lit(0).alias("salt"), F.col("src").alias("doc_id"), F.col("stid").alias("tid"), "pos", F.lit(0).alias("before"), F.lit(0).alias("after"))
        again = again.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(((),)), MET_ROW)
        met = met.where("kind = 0").unionByName(again)
    seed = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("there")
    cell = (F.floor(F.col("pos") / CELL).cast("int").alias("cell"), F.floor((F.col("there") - F.col("pos")) / CELL).cast("int").alias("shift"))
    return met.groupBy("src", "stid", "dst", "dtid", *cell).agg(
        F.min("pos").alias("a"), (F.max("pos") + UNIT).alias("b"), F.min("there").alias("c"), (F.max("there") + UNIT).alias("d"), F.collect_set(seed).alias("seeds")
    )


def equal_run(one: np.ndarray, two: np.ndarray) -> int:
    """How many first words are equal."""
    most, n, step = min(len(one), len(two)), 0, 32
    while n < most:
        differ = one[n : min(n + step, most)] != two[n : min(n + step, most)]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, step = n + step, 4 * step
    return most


class Sides:
    """The word hashes of two texts, with what verification asks of them again and again."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        self.words = one, two
        self.ahead = grams(one, RESUME), grams(two, RESUME)
        self.shingles = None

    def followed(self, x: int, y: int, back: bool = False) -> list[tuple[int, int, int]]:
        """Equal blocks (x, y, length) from x and y on, or back from there, in their
        order, over gaps of up to GAP words."""
        blocks = []
        while True:
            one, two = ((w[:at][::-1] if back else w[at:]) for w, at in zip(self.words, (x, y), strict=True))
            n = equal_run(one, two)
            x, y = (x - n, y - n) if back else (x + n, y + n)
            if n:
                blocks.append((x, y, n) if back else (x - n, y - n, n))
            # the next RESUME words of either side at each width of the gap
            one, two = (g[max(0, at - RESUME - GAP) : max(0, at - RESUME + 1)][::-1] if back else g[at : at + GAP + 1] for g, at in zip(self.ahead, (x, y), strict=True))
            i, j = np.nonzero(one[:, None] == two)
            if not len(i):
                return blocks[::-1] if back else blocks
            best = np.lexsort((i, i + j, np.maximum(i, j)))[0]
            i, j = int(i[best]), int(j[best])
            x, y = (x - i, y - j) if back else (x + i, y + j)

    def similarity(self, a: int, b: int, c: int, d: int) -> float:
        """Exact Jaccard similarity of the shingle sets of words a to b and c to d."""
        if self.shingles is None:
            both = [grams(w, SHINGLE) for w in self.words]
            names, number = np.unique(np.concatenate(both), return_inverse=True)
            self.shingles = number[: len(both[0])], number[len(both[0]) :], len(names)
        one, two, names = self.shingles
        held = np.zeros(names, dtype=np.uint8)
        held[one[a : max(a, b - SHINGLE + 1)]] = 1
        held[two[c : max(c, d - SHINGLE + 1)]] |= 2
        return np.count_nonzero(held == 3) / max(1, np.count_nonzero(held))


def verified_spans(one: np.ndarray, two: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (start, end of one, start, end of two) around paragraphs at the seeds
    (a, c): the longest stretches of equal blocks that are long and similar enough.
    Frequent shifts come first. A seed is done if it lies in a block that another has
    led to, or with both places in one span that has been found."""
    found, seen, sides = [], {}, Sides(one, two)
    often = Counter(c - a for a, c in seeds)
    for a, c in sorted(seeds, key=lambda x: (-often[x[1] - x[0]], x)):
        if any(x <= a < x + n for x, n in seen.get(c - a, ())) or any(i <= a < j and k <= c < m for i, j, k, m in found):
            continue
        back, ahead = sides.followed(a, c, back=True), sides.followed(a, c)
        parts = [back + ahead]
        if back and ahead and back[-1][0] + back[-1][2] == ahead[0][0] and back[-1][1] + back[-1][2] == ahead[0][1]:
            parts = [back[:-1] + [(*back[-1][:2], back[-1][2] + ahead[0][2])] + ahead[1:]]
        elif back and ahead and any(ahead[0][k] - back[-1][k] - back[-1][2] > GAP for k in (0, 1)):
            parts = [back, ahead]  # the paragraph itself lies in too wide a gap
        for blocks in parts:
            for x, y, n in blocks:
                seen.setdefault(y - x, []).append((x, n))
            if blocks and min(blocks[-1][k] - blocks[0][k] for k in (0, 1)) + blocks[-1][2] >= LEAST_WORDS:
                found += [(blocks[0][0], blocks[0][0] + blocks[0][2], blocks[0][1], blocks[0][1] + blocks[0][2])] if len(blocks) == 1 else _stretches(sides, blocks)
    return sorted(set(found))


def _stretches(sides: Sides, blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The longest stretches of blocks in order that make a repeated passage."""
    x, y, n = np.array(blocks, dtype=np.int64).reshape(-1, 3).T
    common = np.concatenate([[0], np.cumsum(np.maximum(0, n - SHINGLE + 1))])
    found, todo = [], [(0, len(blocks))]
    while todo:
        low, high = todo.pop()
        if low == high or min(x[high - 1] - x[low], y[high - 1] - y[low]) + n[high - 1] < LEAST_WORDS:
            continue
        first, last = np.arange(low, high)[:, None], np.arange(low, high)
        one, two = (v[last] + n[last] - v[first] for v in (x, y))
        both = common[last + 1] - common[first]
        # shingles outside of the blocks can be equal by chance only, so few more are common
        able = (first <= last) & (np.minimum(one, two) >= LEAST_WORDS) & (both + SHINGLE >= 0.75 * (one + two - 2 * SHINGLE + 2 - both))
        i, j = np.nonzero(able)
        order = np.lexsort((-j, -i, -(one + two)[i, j]))
        for i, j in zip((i[order] + low).tolist(), (j[order] + low).tolist(), strict=True):
            span = (int(x[i]), int(x[j] + n[j]), int(y[i]), int(y[j] + n[j]))
            if i == j or sides.similarity(*span) >= SIMILARITY:
                found.append(span)
                todo += [(low, i), (j + 1, high)]
                break
    return found


def _slices(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates with the words of both sides as hashes, MARGIN more at both ends."""
    pair = ("src", "stid", "dst", "dtid", "cell", "shift")
    side = lambda doc, tid, lo, hi, seeds, number: F.struct(F.col(doc).alias("doc_id"), F.col(tid).alias("tid"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), seeds.alias("seeds"), F.lit(number).alias("side"))
    both = F.array(side("src", "stid", "a", "b", F.col("seeds"), 0), side("dst", "dtid", "c", "d", F.lit(None).cast("array<long>"), 1))
    joined = docs.join(asked.select(*pair, F.explode(both).alias("x")).select(*pair, "x.*"), "doc_id")

    def cut(batch):
        at, out = [], {"words": [], "begin": []}
        last, words, own = None, None, 0
        for k, (text, tid, lo, hi) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("text", "tid", "lo", "hi")), strict=True)):
            if text != last:
                last, own, words = text, text_id(text), None
            if own != tid:  # another text of this doc_id
                continue
            words = short(word_hashes(text)) if words is None else words
            begin = max(0, lo - MARGIN)
            at.append(k)
            out["words"].append(words[begin : hi + MARGIN].tobytes())
            out["begin"].append(begin)
        names = [*pair, "side", "seeds"]
        kept = batch.select(names).take(pa.array(at, type=pa.int64()))
        return {k: kept.column(k) for k in names} | out

    cut_words = map_batches(bounded_batches(joined), cut, "src long, stid int, dst long, dtid int, cell int, shift int, side int, seeds array<long>, words binary, begin int")
    pick = lambda s, *names: F.max(F.when(F.col("side") == s, F.struct(*names)))
    met = cut_words.groupBy(*pair).agg(pick(0, "begin", "words", "seeds").alias("x"), pick(1, "begin", "words").alias("y"))
    return met.select(*pair[:4], F.col("x.words").alias("one"), F.col("y.words").alias("two"), F.col("x.begin").alias("at"), F.col("y.begin").alias("there"), F.col("x.seeds").alias("seeds"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(src, stid, start, end, dst, dtid, dst_start, dst_end): verified repeats, in words."""
    docs = texts(df, id_col, text_col).where("doc_id is not null")
    return checked(docs, written(candidates(docs), "candidates"))


def checked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The spans that the words of both sides of the candidates bear out."""

    def verify(batch):
        out: dict[str, list] = {k: [] for k in SPAN_NAMES}
        for r in batch.to_pylist():
            if r["one"] is None or r["two"] is None:
                continue
            at, there = r["at"], r["there"]
            one, two = (np.frombuffer(r[k], dtype="<u4").astype(np.uint64) for k in ("one", "two"))
            seeds = [((x >> 32) - at, (x & 0xFFFFFFFF) - there) for x in r["seeds"]]
            for low, high, first, last in verified_spans(one, two, seeds):
                for k, v in zip(out, (r["src"], r["stid"], low + at, high + at, r["dst"], r["dtid"], first + there, last + there), strict=True):
                    out[k].append(v)
        return out

    return map_batches(bounded_batches(_slices(docs, asked)), verify, SPAN_ROW)


@scoped
def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per instance of a repeated passage: doc_id, start_word, end_word,
    n_words, component_doc, component_start, kept, and text_id, which tells the texts
    of one doc_id apart. Documents without repeats have no row. Of a component, the
    instance in the smallest document is kept."""
    spans = written(repeated_spans(df, id_col, text_col), "spans")
    one = F.struct(F.col("src").alias("doc_id"), F.col("stid").alias("tid"), F.col("start").alias("s"), F.col("end").alias("e"))
    two = F.struct(F.col("dst").alias("doc_id"), F.col("dtid").alias("tid"), F.col("dst_start").alias("s"), F.col("dst_end").alias("e"))
    ends = spans.select(F.explode(F.array(one, two)).alias("x")).select("x.*").distinct()
    before = W.partitionBy("doc_id", "tid").orderBy("s", "e")
    opens = F.coalesce((F.col("s") >= F.max("e").over(before.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1))
    islands = ends.withColumn("opens", opens).withColumn("island", F.sum("opens").over(before))
    whole = W.partitionBy("doc_id", "tid", "island")
    islands = islands.select("doc_id", "tid", "s", "e", F.min("s").over(whole).alias("first"), F.max("e").over(whole).alias("last"))
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")  # so that text orders negative numbers too
    node = F.concat_ws(":", F.lpad((F.col("doc_id").cast("decimal(20,0)") + half).cast("decimal(20,0)").cast("string"), 20, "0"), F.lpad(F.col("first").cast("string"), 12, "0"), F.col("tid").cast("string"))
    nodes = written(islands.withColumn("node", node), "islands")
    side = lambda names, to: nodes.select(*[F.col(a).alias(b) for a, b in zip(("doc_id", "tid", "s", "e", "node"), (*names, to), strict=True)])
    source, target = ("src", "stid", "start", "end"), ("dst", "dtid", "dst_start", "dst_end")
    edges = spans.join(side(source, "x"), list(source)).join(side(target, "y"), list(target)).select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
    parts = connected_components(edges)
    known = nodes.select("doc_id", F.col("first").alias("start_word"), F.col("last").alias("end_word"), F.col("tid").alias("text_id"), "node").distinct()
    found = known.join(parts, "node")
    return found.select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
        (F.split_part("component", F.lit(":"), F.lit(1)).cast("decimal(20,0)") - half).cast("long").alias("component_doc"), F.split_part("component", F.lit(":"), F.lit(2)).cast("int").alias("component_start"),
        (F.col("node") == F.col("component")).alias("kept"), "text_id",
    )
