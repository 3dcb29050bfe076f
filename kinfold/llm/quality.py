"""Operator 5: a quality classifier of supervised subword embeddings.

A word gives hashed features: itself, its shape, its character n-grams, and a
mark where it repeats the word before it. Each feature has a learned vector; a
document is the average of its features' vectors, and a softmax layer on top
gives the probability of label 1. Vectors and layer are trained together by
stochastic gradient descent in numpy.

Training takes at most SAMPLE labelled documents (those first by a hash of their
doc_id), and of them only rows whose fold is not held out. Their features are
extracted on the executors; at most FEATURES numbers of them are learned from. Scores are
for all documents and whole texts: as average and layer are linear, a feature
adds one number to the log odds, and a word the sum of its features'.

Edge cases: null and empty texts have no features and score what the layer's
bias gives; rows with a null label or doc_id, and documents whose labels disagree,
are not learned from; equal scores are ties that stay equal; without
usable labels every score is 0.5 (predicted 1); repeated rows repeat their
result; an empty table gives an empty result; other columns are never read.
"""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.arrow import bounded_batches, map_batches, texts
from kinfold.operators.storage import scratch, written

#: Documented bound of the training sample, in documents.
SAMPLE = 4000
#: Documented bound of their features that go to the driver, in numbers, and share of
#: it that the rows of one doc_id may have.
FEATURES, LARGEST = 1 << 24, 0.1
BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 5
CACHE, LONGEST = 400_000, 48
_RUNS = re.compile(r"(.)\1+")


#: Start values that keep the hashes of words, shapes and n-grams apart.
_WORD, _SHAPE, _GRAM, _REPEAT = 1, 2, 3, 4


def shape(word: str) -> str:
    """The word with letters and digits replaced by their class, runs shortened."""
    if word.isalpha():  # the frequent cases, with the same result
        if word.islower():
            return "x+" if len(word) > 1 else "x"
        if len(word) > 2 and word[0].isupper() and word[1:].islower():
            return "Xx+"
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1+", kinds)


def word_features(word: str) -> list[int]:
    """Buckets of a word, its shape and its character n-grams."""
    crc, marked = zlib.crc32, f"<{word}>"
    data = marked.encode("utf-8", "surrogatepass")
    found = [crc(data, _WORD), crc(shape(word).encode("utf-8", "surrogatepass"), _SHAPE)]
    if len(data) == len(marked):
        found += [crc(data[i : i + n], _GRAM) for n in GRAMS for i in range(len(data) - n + 1)]
    else:
        found += [crc(marked[i : i + n].encode("utf-8", "surrogatepass"), _GRAM) for n in GRAMS for i in range(len(marked) - n + 1)]
    return [f & (BUCKETS - 1) for f in found]


REPEAT = zlib.crc32(b"", _REPEAT) & (BUCKETS - 1)


def document_features(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often a whole text has them."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    words = text.split()
    for word in words:
        own = known.get(word)
        if own is None:
            own = np.array(word_features(word))
            if len(word) <= LONGEST and len(known) < CACHE:
                known[word] = own
        np.add.at(counts, own, 1)
    counts[REPEAT] += sum(map(str.__eq__, words, words[1:]))
    at = np.flatnonzero(counts)
    return at, counts[at]


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each (1, 2 or 4) that hold the largest."""
    most = int(counts.max(initial=0))
    return np.minimum(counts, 2**32 - 1).astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def widths(buckets: bytes, counts: bytes) -> np.ndarray:
    """The counts that ``narrow`` has packed beside buckets of two bytes."""
    return np.frombuffer(counts, f"<u{2 * len(counts) // max(1, len(buckets)) or 1}")


def train(documents: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds of label 1, and the bias."""
    if len({y for *_, y in documents}) < 2:
        return np.zeros(BUCKETS), 0.0
    random = np.random.default_rng(SEED)
    vectors = random.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = random.normal(0, 1 / WIDTH, (WIDTH, 2)), np.zeros(2)
    documents = [d for d in documents if len(d[0])]  # shares are doubles, so they are made as needed
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(documents)):
            buckets, counts, y = documents[i]
            share = counts / counts.sum()
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[buckets]
            odds = hidden @ layer + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * p
            vectors[buckets] -= (rate * len(buckets) ** 0.5) * share[:, None] * back
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


class Scorer(dict):
    """Summed log odds (real part) and feature count (imaginary part) of words."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight.astype(np.float64), bias

    def __missing__(self, word: str) -> complex:
        own = word_features(word)
        value = complex(float(self.weight[own].sum()), len(own))
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value

    def score(self, text: str) -> float:
        """The probability of label 1."""
        words = text.split()
        total = sum(map(self.__getitem__, words), 0j)
        repeats = sum(map(str.__eq__, words, words[1:]))
        total += repeats * complex(float(self.weight[REPEAT]), 1)
        odds = (total.real / total.imag if total.imag else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(odds, -60, 60))))


def held_out(doc_id: F.Column) -> F.Column:
    """Whether the fold of a doc_id is the one that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Train on at most ``sample`` labelled documents outside the held-out fold, and of
    those on the first by hash that have FEATURES numbers in all."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id")))
    y = F.col(label_col).cast("int")  # documents whose labels disagree teach nothing
    usable = usable.groupBy("doc_id").agg(F.min(y).alias("y"), F.max(y).alias("most")).where("y = most").drop("most")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its rows are bounded by the sample
    own = texts(docs).join(F.broadcast(chosen), "doc_id")

    def extract(batch):
        known: dict[str, np.ndarray] = {}
        for i, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True):
            buckets, counts = document_features(text, known)
            yield {"doc_id": [i], "buckets": [buckets.astype("<u2").tobytes()], "counts": [narrow(counts)], "y": [y]}

    with scratch(docs.sparkSession):
        rows = written(map_batches(own, extract, "doc_id long, buckets binary, counts binary, y int").withColumn("h", F.xxhash64("doc_id")), "features")
        sizes = rows.groupBy("h").agg((F.sum(F.octet_length("buckets")) / 2).alias("n")).where(F.col("n") <= LARGEST * FEATURES).orderBy("h").collect()
        held = [r.h for r, n in zip(sizes, np.cumsum([r.n for r in sizes]).tolist(), strict=True) if n <= FEATURES]
        found = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in held], "h long")), "h").collect()
    rows = sorted(found, key=lambda r: (r.doc_id, bytes(r.buckets), bytes(r.counts)))
    return train([(np.frombuffer(r.buckets, "<u2"), widths(r.buckets, r.counts), r.y) for r in rows])


def score_column(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> F.Column:
    """The score of each row as a column, to filter whole rows by."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    made: dict[int, Scorer] = {}

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        if 0 not in made:
            made[0] = Scorer(*shared.value)
        return found.map(made[0].score).astype("float64")

    return score(F.coalesce(F.col(text_col), F.lit("")))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    made: dict[int, Scorer] = {}

    def score(batch):
        if 0 not in made:
            made[0] = Scorer(*shared.value)
        return {"doc_id": batch.column("doc_id"), "score": [made[0].score(t) for t in batch.column("text").to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(texts(docs, id_col, text_col), score, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
