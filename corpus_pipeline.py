"""A corpus pipeline of five stages: toxicity, line dedup, near duplicates, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import line_dedup, mixing, ngram_join, sentencepiece_io, toxicity
from tickloom.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects; it learns from the labelled rows outside fold 1.

    Null and empty texts have the model's bias as score and stay unless that alone is over the threshold. Equal texts, repeated rows among
    them, share a fate. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="score").where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that stand on many sites, but for their first document, and documents of which nothing is left by that.

    n_chars follows the text. Documents without removed lines stay as they are, null and empty texts included.
    """
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\t\r\n", "   ")) == "")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", chars).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id; of its repeated rows one."""
    docs = docs.select(*COLUMNS)
    chiefs = ngram_join.similar_groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__row", F.xxhash64("text"))
    kept = hashed.join(chiefs.hint("merge"), (F.col("__row") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("__row", "doc_id").orderBy("source", "lang", "n_chars"))
    return kept.withColumn("__turn", turn).where("__turn = 1").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    A document comes as often as it is taken; null and empty texts go by their hash like all others. An empty table stays empty.
    """
    mixed = mixing.mix(docs.select(*COLUMNS)).where("mix_repeats > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_repeats")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the end of each piece in the original bytes.

    Null counts as empty, which gives the begin and end ids alone; repeated rows give repeated results. An empty table stays empty.
    """
    docs = docs.select("doc_id", "source", "text")
    return sentencepiece_io.encode(docs, sentencepiece_io.model_path(), columns=("n_tokens", "ids", "ends", "decoded_sha256")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The classifier and the tokenizer are not SQL; tests/llm replays the stages after the classifier in plain Python over a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Each result is a table in the shared folder, read back by the next stage.

    The tables stay there, since the result is read from the last of them.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
