"""Fetching both texts of stated pairs with one shuffle of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, a, b): each pair with the distinct texts of its two documents,
    in lists (of one text each, unless rows share a doc_id).

    ``docs`` has doc_id and text; ``pairs`` has src and dst. A document asked for
    very often is dealt over tasks by adaptive execution.
    """
    asked = pairs.select("src", "dst", F.explode(F.array(F.struct(F.col("src").alias("doc_id"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("doc_id"), F.lit(1).alias("side")))).alias("x"))
    got = docs.select("doc_id", "text").join(asked.select("src", "dst", "x.*"), "doc_id")
    both = got.groupBy("src", "dst").agg(F.collect_set(F.when(F.col("side") == 0, F.col("text"))).alias("a"), F.collect_set(F.when(F.col("side") == 1, F.col("text"))).alias("b"))
    return both
