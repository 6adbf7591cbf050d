"""A corpus made ready for training: filter, deduplicate, cut repeats, mix, pack.

``STAGES`` are applied in order, each to all rows that the one before kept; between
stages the rows are written as Parquet in the shared folder and read again.  All but
the last return the columns of ``documents``.

NULL and empty texts pass the stages as texts without words: the classifier scores
them, the near-duplicate stage keeps one of them, mixing takes nothing of a text without words.  Further columns are
carried along, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.llm import mixing, packing, quality, simhash, substring
from shelfproof.llm.common import apart, size_of, stored
from shelfproof.llm.queries import learn_quality


#: Words a packing worker keeps; workers of the stages before it may still hold memory.
REMEMBERED = 150_000


def _with_chars(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, ``n_chars`` counted anew where there is one."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_quality())
    return docs.where(quality.score(net, F.col("text")) >= quality.THRESHOLD)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the SimHash index proposes, whole sets of shingles decide."""
    return simhash.without_near_duplicates(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those of which nothing is left go."""
    def job(d: DataFrame, at: Callable[[str], str]) -> DataFrame:
        cut = substring.without_repeats(d, at("doc_id"), at("text"))
        gone = (F.col("removed_words") > 0) & (F.trim("kept_text") == "")
        return cut.where(~gone).withColumn(at("text"), F.col("kept_text"))

    return _with_chars(apart(docs, job), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row for each time a document is taken, shards together and shuffled."""
    def job(d: DataFrame, at: Callable[[str], str]) -> DataFrame:
        # Counted once and written: the plan's jobs read the sizes, not the texts.
        sized = stored(d.withColumn("_size", size_of(F.col(at("text")))), "sized")
        planned = mixing.plan(sized, at("doc_id"), at("source"), "_size")
        return mixing.emit(planned, at("doc_id"), at("text"), "_size")

    return _with_chars(apart(docs, job), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, remembered=REMEMBERED)


STAGES = [("quality", good), ("near_duplicates", unlike), ("repeated_passages", unrepeated), ("mixing", mixed),
          ("packing", packed)]

#: The classifier cannot be written in SQL; tests compare near-duplicates, repeats, mix and packing with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
