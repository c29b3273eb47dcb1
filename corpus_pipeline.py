"""The corpus pipeline: quality rules, exact and near duplicates, mixing, encoding.

Every stage takes documents with any columns beside doc_id, text and source, none of which it changes, and handles nulls in any
of them, empty and very long texts, ties, repeated rows and empty tables, as stated for each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import blocks, mixing, quality, sentencepieces, shingles
from sparkquarry.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. Null and empty texts have fewer words than are asked for, and go; texts are judged whole and
    each by itself, so repeated rows stay or go together."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id. Null texts equal empty ones; null ids are smaller than any other; of rows alike in id
    and text one stays."""
    return blocks.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked by a similarity of 0.8 on five-word shingles, the document with the smallest id. Texts meet in the grid of their
    SimHash fingerprints, and by minima where that doesn't reach; then their whole sets are compared. Texts without words, null ones too, are alike; rows without an id come last; of rows alike in id and text one stays."""
    return shingles.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; null texts have no size; what rows alike in all
    are taken for, each by itself, adds up alike whatever their order; a source without words is taken zero times."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy, and whether they decode to its text. Null and empty texts have no ids; null ids and repeated rows are encoded like any
    others, and long texts whole."""
    encoded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The stages of shingles, components and pieces can't be put in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage keeps is written as Parquet to the shared folder and read from there by the
    next, after which it is deleted; a lost executor repeats tasks of one stage only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < last:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        if 0 < k < last:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
