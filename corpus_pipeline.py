"""A collection made ready in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm import bpe, mixing, quality, simhash, substrings
from talentweave.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality network, fitted on the labelled ones among them, does not reject.

    Every row is judged by its text alone: null and blank texts as documents without words, rows without an id and
    repeated rows like any other, equal texts alike.  An empty table gives no rows; columns other than those of
    documents are left behind.
    """
    docs = _documents(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike by 0.8 or more (five-word shingles) one row: that of the least doc_id, nulls last.

    Rows without an id are in the groups like any other; of rows that repeat (equal id and text) one stays; null and
    blank texts are one group; an empty table gives no rows.
    """
    return simhash.one_of_each(_documents(docs), words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; rows that have nothing left go.

    Every occurrence of a passage goes, the first one too, as the stage's operator has it; whole texts that stand
    in several rows were made one row by the stage before.  Null and blank texts go; ids and repeats of ids do not
    matter; an empty table gives no rows.
    """
    docs = substrings.without_repeats(_documents(docs))
    return docs.withColumn("n_chars", F.length("text").cast("long")).where("trim(text) <> ''").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them.

    A null source is a source; rows without an id are told apart by their texts; rows that repeat share one hash and
    are taken alike; texts without words are not taken; an empty table gives no rows.
    """
    return mixing.repeated(_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, for every row, repeated ones too.

    Null texts are empty; an empty table gives no rows.
    """
    return bpe.round_trip(docs)


STAGES = [("quality", keep_quality), ("near duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("mix", mix_sources), ("encode", encode)]

#: SQL can't express the trained network, hashes by bit and byte-pair merges; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
