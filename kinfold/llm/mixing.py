"""Operator 4: mixing sources to target weights by a hypergeometric splitting tree.

Documents are cut into blocks of at most BLOCK_WORDS words, and each source's
blocks stand in a random order that a seed fixes. A source whose target is above
its size is taken whole as often as fits, the rest as the first blocks of its
order, the last of them trimmed, so every source takes its target to the word.
The order is a distributed prefix sum: hash ranges of a source are counted, and
places are numbered within a range, so that no task orders a whole source. Rows
that repeat another in full are told apart by a number, and so spread like others.

The blocks of all sources are split among output shards by a tree: at each node a
multivariate-hypergeometric draw decides how many blocks of each source go left.
A leaf has its exact quota of each source; it draws a run of that length from
the source's order, disjoint from all other shards', and shuffles it locally. The
mix is what the leaves draw: a block that no leaf has is not taken. There are as
many shards as the words ask for.

Edge cases: a null text has size 0 and takes nothing; a null source is a source
of its own, last in order; repeated rows count each; a mix without words takes
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.llm.arrow import bounded_batches, map_batches
from kinfold.operators.storage import scoped, written

#: A word, for Java's and Python's pattern language alike.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, RANGE_BLOCKS = 1024, 4096
#: Words of a shard, least number of shards, and tasks that write one.
SHARD_WORDS, LEAST_SHARDS, PARTS = 1 << 28, 64, 8
#: Tasks that number the rows that repeat one in full.
SALTS = 64


def source_targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets by repeating weights that sum to ``share`` of all sizes, none above
    ``most`` times its own size; what a full source can't take is reshared."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total, bound = share * sum(sizes), [most * s for s in sizes]
    target = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i]]
    full: set[int] = set(range(len(sizes))) - set(free)
    while free:
        left = total - sum(bound[i] for i in full)
        unit = left / sum(weight[i] for i in free)
        over = [i for i in free if weight[i] * unit > bound[i]]
        if not over:
            for i in free:
                target[i] = weight[i] * unit
            break
        full |= set(over)
        free = [i for i in free if i not in full]
    for i in full:
        target[i] = bound[i]
    return target


def _draw(random: np.random.Generator, quotas: list[int], left: int) -> list[int]:
    """A multivariate-hypergeometric draw of ``left`` from ``quotas``, any size."""
    total = sum(quotas)
    shift = max(0, total.bit_length() - 29)
    coarse = np.array([q >> shift for q in quotas])
    if not left or not coarse.sum():
        taken = [0] * len(quotas)
    else:
        taken = [int(t) << shift for t in random.multivariate_hypergeometric(coarse, min(left >> shift, int(coarse.sum())), method="marginals")]
    rest = left - sum(taken)
    for i in range(len(quotas)):  # what the shift cut off
        more = min(rest, quotas[i] - taken[i])
        taken[i] += more
        rest -= more
    return taken


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard its quota of each source; quotas are used up exactly."""
    random, total = np.random.default_rng(seed), sum(quotas)
    room = [total * (k + 1) // shards - total * k // shards for k in range(shards)]

    def split(own: list[int], low: int, high: int) -> list[list[int]]:
        if high - low == 1:
            return [own]
        middle = (low + high) // 2
        left = _draw(random, own, sum(room[low:middle]))
        return split(left, low, middle) + split([a - b for a, b in zip(own, left, strict=True)], middle, high)

    return split(quotas, 0, shards)


def sized_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, source, size, digest): a stored table with a number for each row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.xxhash64(id_col, text_col, source_col)
    return written(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), digest.alias("digest"), *carry), "sized")


def _numbered(rows: DataFrame) -> DataFrame:
    """(row, copy): a number among the rows of one digest, so that reruns agree on
    the numbers a digest has; SALTS tasks share the rows of a frequent one."""
    dealt = rows.select("row", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    count = dealt.groupBy("digest", "salt").count()
    ahead = F.coalesce(F.sum("count").over(W.partitionBy("digest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = dealt.withColumn("r", F.row_number().over(W.partitionBy("digest", "salt").orderBy("row")) - 1)
    return local.join(count.select("digest", "salt", ahead.alias("ahead")), ["digest", "salt"]).select("row", (F.col("ahead") + F.col("r")).alias("copy"))


def mix(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int | None = None, block: int = BLOCK_WORDS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The plan of the sources, and the draws of blocks.

    ``rows`` is a stored table (row, doc_id, source, size, digest). Plan: source,
    source_size, target. Draws: row, part, parts, epoch, words, whole, shard,
    place; sorting a shard by place shuffles it. One row for each source goes
    to the driver, and the tree's leaves come from there.
    """
    spark = rows.sparkSession
    parts = F.ceil(F.col("size") / block).cast("int")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(parts).cast("long").alias("blocks")).collect()
    per_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    targets = source_targets([r["size"] for r in per_source], weights, share, most)
    words = [math.floor(t + 0.5) for t in targets]
    epochs = [w // r["size"] if r["size"] else 0 for w, r in zip(words, per_source, strict=True)]
    rest = [w - e * r["size"] for w, e, r in zip(words, epochs, per_source, strict=True)]
    bits = [max(0, math.ceil(math.log2(max(1, r.blocks / RANGE_BLOCKS)))) for r in per_source]
    kinds = f"source {rows.schema['source'].dataType.simpleString()}, number int, source_size long, target double, epochs int, rest long, bits int, blocks long"
    plan = spark.createDataFrame([(r.source, k, r["size"], t, e, x, b, r.blocks) for k, (r, t, e, x, b) in enumerate(zip(per_source, targets, epochs, rest, bits, strict=True))], kinds)

    sized = rows.where("size > 0").join(_numbered(rows), "row")
    blocks = sized.select("row", "source", "size", "digest", "copy", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    blocks = blocks.withColumn("words", F.floor((F.col("part") + 1) * F.col("size") / F.col("parts")) - F.floor(F.col("part") * F.col("size") / F.col("parts")))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed), "digest", "copy", "part"))
    same = blocks["source"].eqNullSafe(plan["source"])
    ranged = blocks.join(plan.drop("source_size", "target"), same).drop(plan["source"])
    ranged = ranged.withColumn("span", F.expr("IF(bits = 0, 0L, shiftrightunsigned(h, 64 - bits))"))

    before = W.partitionBy("number").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("number", "span").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    sums = sums.select("number", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = W.partitionBy("number", "span").orderBy("h", "row", "part")
    ranked = ranged.select("*", F.row_number().over(inside).alias("r"), F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)).alias("w")).join(sums, ["number", "span"])
    ordered = written(ranked.select("row", "number", "part", "parts", "words", "h", "epochs", "rest", "blocks", (F.col("n0") + F.col("r") - 1).alias("rank"), (F.col("w0") + F.coalesce("w", F.lit(0))).alias("ahead")), "blocks")

    partly = {r.number: r.n for r in ordered.where("ahead < rest").groupBy("number").agg(F.count("*").alias("n")).collect()}
    quotas = [e * r.blocks + partly.get(k, 0) for k, (r, e) in enumerate(zip(per_source, epochs, strict=True))]
    leaves = splitting_tree(quotas, shards or max(LEAST_SHARDS, -(-sum(words) // SHARD_WORDS)), seed) if quotas else []
    ends = np.cumsum(np.array(leaves, dtype=np.int64).reshape(len(leaves), len(quotas)), axis=0)

    def draw(batch):
        """Each place of a source's order with the leaf whose run it lies in."""
        number, epoch, blocks, rank = (batch.column(c).to_numpy() for c in ("number", "epoch", "blocks", "rank"))
        shard = np.full(len(number), -1, dtype=np.int32)
        for k in np.unique(number).tolist():
            own = number == k
            at = epoch[own] * blocks[own] + rank[own]
            shard[own] = np.where(at < ends[-1, k], np.searchsorted(ends[:, k], at, side="right"), -1)
        held = shard >= 0
        return {c: batch.column(c).filter(pa.array(held)) for c in ("row", "part", "parts", "epoch", "words", "whole", "place")} | {"shard": shard[held]}

    times = F.col("epochs") + F.when(F.col("ahead") < F.col("rest"), 1).otherwise(0)
    copies = ordered.where("epochs > 0 or ahead < rest").withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    copies = copies.select(
        "number", "blocks", "rank", "row", "part", "parts", F.col("epoch").cast("long").alias("epoch"),
        F.when(F.col("epoch") < F.col("epochs"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("ahead"))).alias("words"),
        (F.col("epoch") < F.col("epochs")).alias("whole"),
        F.xxhash64(F.lit(seed + 1), "h", "epoch").alias("place"),
    )
    draws = map_batches(bounded_batches(copies), draw, "row long, part int, parts int, epoch long, words long, whole boolean, place long, shard int")
    return plan.select("source", "source_size", "target"), draws


@scoped
def mixed_sizes(df: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the leaves draw),
    first_shard and last_shard (of its blocks; null if none is drawn)."""
    rows = sized_rows(df)
    plan, draws = mix(rows, **options)
    taken = draws.groupBy("row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    found = rows.join(taken, "row", "left").join(plan, rows["source"].eqNullSafe(plan["source"]))
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


@scoped
def mixed_documents(df: DataFrame, length_col: str = "n_chars", **options) -> DataFrame:
    """The mix as rows of the columns of ``df``, shard by shard in shuffled order.

    A document taken whole gives its row as often as it is taken; of one taken
    in part, the blocks taken give one row. ``length_col`` is the text's length.
    """
    names, word = list(df.columns), re.compile(WORD)
    rows = sized_rows(df, carry=tuple(F.col(f"`{c}`").alias(f"_{c}") for c in names))  # no name of ours begins so
    _, draws = mix(rows, **options)
    own = draws.groupBy("row", "epoch").agg(F.min("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("part", "words"))).alias("taken"), F.min("shard").alias("shard"), F.min("place").alias("place"))
    joined = bounded_batches(rows).join(own.hint("shuffle_hash"), "row")

    def cut(batch):
        texts, out = [], {f"_{c}": batch.column(f"_{c}") for c in names}
        for text, size, parts, taken in zip(*(batch.column(c).to_pylist() for c in ("_text", "size", "parts", "taken")), strict=True):
            if len(taken) == parts and sum(t["words"] for t in taken) == size:
                texts.append(text)
                continue
            spans = [m.span() for m in word.finditer(text)]
            pieces = []
            for t in taken:
                first = t["part"] * size // parts
                if t["words"]:
                    pieces.append(text[spans[first][0] : spans[first + t["words"] - 1][1]])
            texts.append("\n".join(pieces))
        out["_text"] = texts
        if f"_{length_col}" in out:
            out[f"_{length_col}"] = [None if t is None else len(t) for t in texts]
        yield out | {"shard": batch.column("shard"), "place": batch.column("place")}

    kinds = dict(df.dtypes)
    mixed = map_batches(joined, cut, ", ".join([*(f"`_{c}` {kinds[c]}" for c in names), "shard int, place long"]))
    placed = mixed.repartition("shard", F.pmod("place", F.lit(PARTS))).sortWithinPartitions("shard", "place")
    return placed.select(*[F.col(f"`_{c}`").alias(c) for c in names])
