"""A corpus from raw documents: filter, dedup, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of the documents, whatever these are. Null texts count as empty, and
texts without words are alike to near-dedup, so one of them stays; rows without a
doc_id pass through the dedup stages; of rows that share a doc_id near-dedup keeps
all or none; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import lines, mixing, packing, quality, simhash
from kinfold.operators.storage import scratch, written
from kinfold.sources.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(docs, model) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters in 3 or more documents stay in one of them; a
    document that loses all its lines stays with an empty text."""
    kept = lines.dedup_lines(docs, 20, 3, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    now = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"`_{c}`") for c in docs.columns}
    if "n_chars" in now:
        now["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[column.alias(c) for c, column in now.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike (five-word shingles, similarity 0.8), the
    one with the smallest doc_id stays."""
    gone = simhash.similar_groups(docs, words=5, similarity=0.8).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights 5, 2, 1 up to 150 % of all words."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express a stage; the tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as own:  # what a stage wrote besides its result goes
            docs = own.keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
