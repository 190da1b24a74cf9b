"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes all documents that the one before kept and returns those it keeps, with all their columns, whatever
their names; the last one returns token ids. An empty table stays empty. Very long texts go through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetweave.llm import bpe, decontam, quality, substring, superminhash
from fleetweave.llm._spark import Workspace, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on the labelled rows among the documents.

    Null texts go, empty ones are judged by the bias; repeated rows are judged alike; null ids are judged like others.
    """
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_filter(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all documents in no group.

    Of a group stays the smallest doc_id, of equal rows one; rows with a null id or text are in no group and stay; rows
    that share a doc_id are told apart by their texts.
    """
    return superminhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document (smaller doc_id) holds.

    What has no word left goes; null ids and texts and empty texts stay as they are; rows that share a doc_id are cut
    each by itself.
    """
    return substring.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; null and empty texts overlap none, and repeated rows go or stay together."""
    return decontam.without(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, n_bytes, round_trip) of each row; null texts have null ids, empty ones none."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE encoding and decoding", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage but the last is written to the workspace and read again.

    What the result still reads goes with ``fleetweave.llm._spark.clean`` or at the end of the session.
    """
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.write(docs, f"stage{k}", keep=True)
            if k > 0:
                ws.drop(f"stage{k - 1}")
    return docs
