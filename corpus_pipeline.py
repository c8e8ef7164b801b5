"""A corpus pipeline of five stages: toxicity, exact duplicates, near duplicates, mixture, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.

What every stage does with odd rows: null texts count as empty; null, empty and very long texts pass through whole. Rows that share a doc_id,
or have none, are decided one by one: their own text counts, never another row's. Of rows with the same doc_id and text one stays after the second
stage. An empty table goes through as an empty table. Columns beyond those of documents pass through the first four stages, whatever their names
(names beginning with __mx_ are refused by the mixture). A stage's plan belongs to a session of its own with runtime.WIDE_ROWS; the caller's session is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserix.llm import bpe, mixing, ngram_join, toxicity, trie
from tesserix.llm.queries import vocabulary
from tesserix.runtime import forget, in_wide_session, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. Null, empty and wordless texts stay; a table without labels of both classes rejects by its base rate."""
    own = in_wide_session(docs)
    return toxicity.toxicity_filter(own, table(own.sparkSession, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for runs of white space, one row: the one with the smallest doc_id (null ones last). Null equals empty."""
    return trie.exact_filter(in_wide_session(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the one with the smallest doc_id (null ones last). Texts without words have no copies."""
    return ngram_join.ngram_filter(in_wide_session(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights. Texts without tokens have weight 0 and aren't sampled; null source and lang are levels of their own."""
    return mixing.mix_filter(in_wide_session(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, digested together with the decoded text. Null and empty texts have no ids."""
    return bpe.round_trip_digests(in_wide_session(docs), vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixture", mix), ("byte-pair encoding", encode)]

#: The classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. A stage's table is deleted when the next one is written, the last one stays for the caller."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = saved(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            forget(spark, docs)
        docs = done
    return docs
