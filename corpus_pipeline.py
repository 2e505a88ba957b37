"""A corpus pipeline of five stages, each one operator of sluiceway.llm.

Every stage takes the documents its predecessor kept and returns rows with the columns of
documents; the last returns each document's token ids beside its decoded text. Row-wise stages
carry the documents' columns through their operator, so no text is joined back.

Edge cases: rows with a null id are judged by their own text in the stages language, leaks and
tokens, and are kept as they are by the two that compare documents. Rows that share an id share
the decision and, where their texts differ, the least of these in those two stages. Null and
empty texts go in the first stage (no language). Columns other than those of documents are
dropped. Empty tables give empty results; an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import langid
from sluiceway.llm.bpe import bpe_round_trip
from sluiceway.llm.decontaminate import decontaminate
from sluiceway.llm.near_dedup import near_dedup
from sluiceway.llm.queries import vocabulary
from sluiceway.llm.shared import Scratch
from sluiceway.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a document's mixture that its main language must have.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose main language is clear; ``lang`` becomes the prediction."""
    found = langid.language_id(docs, langid.learn(docs), carry=["text", "source", "n_chars"])
    clear = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return clear.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates (five words, 0.8)."""
    copies = near_dedup(docs, shingle=5, share=80).filter("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that earlier documents hold; a document of which nothing is left goes."""
    cut = substring_dedup(docs, carry=["text", "lang", "source"]).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS[1:])
    return found.filter("not contaminated").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its text as decoded from them."""
    return bpe_round_trip(docs, tokenizer=vocabulary("byte_bpe_50k.json")).select("doc_id", "text", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("leaks", leaks), ("tokens", tokens)]

#: SQL can't express the language stage, which learns a model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
