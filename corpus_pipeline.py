"""A corpus pipeline over documents: quality rules, line and near de-duplication, mixing, and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows of the stage before, which are
written as Parquet and read again. All stages but the last return the columns of documents.

In every stage an empty table gives an empty result, other columns pass unchanged whatever their names, texts are worked
on whole however long, and repeated rows are rows of their own but where a stage's task is to drop them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workgraph.llm import linedup, mixing, neardup, quality, subword
from workgraph.llm._shared import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and blank texts go; a null lang is judged without a language's words; a distance
    equal to its limit stays."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that one of smaller id holds; n_chars, where there is one, follows the text. Null text
    becomes ''; rows of null id lose nothing."""
    out = linedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a Jaccard of 0.8: the one of smallest id.
    Documents without an id, and texts without a word, stay; rows of one id stay or go together."""
    found = neardup.near_duplicates(docs, percent=80, shallow=3)
    gone = found.filter("id <> component_id").select(F.col("id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, up to three times, arranged by its shards and shuffled in each. Null sources
    are a source; null texts follow their block's draws."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source where there are such, the piece ids, how many, and whether they decode to the text. Null
    text: null ids, n_ids null, true."""
    out = subword.encode(docs, check="round_trip", nodes=2_000_000)  # executors hold the stages before, too
    return out.select(*[c for c in ("doc_id", "lang", "source") if c in docs.columns], "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL cannot express the near-duplicate, mixing and encoding stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
