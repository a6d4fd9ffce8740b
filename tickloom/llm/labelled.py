"""Folds and bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import named


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; 1 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % 3, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts and labels of at most limit rows, the first by a hash of the id: columns text, y.

    Rows of fold 1, and rows with a null id, label or text, are left out; of an id labelled twice the smallest label
    counts. The ids chosen are at most limit, and so may be broadcast against the documents.
    """
    usable = labels.select(named(doc_id).alias("id"), named(label).cast("int").alias("y")).where("id is not null and y is not null")
    usable = usable.where(F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3, F.lit(0)) != 1)
    chosen = usable.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(named(doc_id).alias("id"), named(text).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "id")
    return found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("text", "y")
