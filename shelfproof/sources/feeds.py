"""JSON-lines feeds of records: read in order, written gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.operators import merge
from shelfproof.operators.validate import serialise
from shelfproof.schema import LISTING


def read_feed(spark: SparkSession, path: str, schema=LISTING, present: bool = False) -> DataFrame:
    """One feed (a file, a folder or a glob; plain or gzipped), blank lines skipped.

    ``present`` adds ``present_keys``, the keys each record has, so that a key set to null
    can be told from one that is not there.

    ``ord`` keeps line order: file, then block within the file, then row within
    the block.  No rows are moved to number them.  A gzipped file is one task,
    so a large feed is converted to Parquet once (``to_table``).
    """
    if present:
        lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_metadata_", F.col("_metadata"))
        record = F.from_json("value", schema, {"mode": "FAILFAST"})
        return lines.select(
            record.alias("_r"), F.json_object_keys("value").alias("present_keys"), F.struct(
                F.col("_metadata_.file_path").alias("file"), F.col("_metadata_.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row")).alias("ord")).select("_r.*", "present_keys", "ord")
    return (spark.read.schema(schema).option("mode", "FAILFAST").json(path)
            .withColumn("ord", F.struct(
                F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"))))


def read_feeds(spark: SparkSession, paths: list[str], schema=LISTING, present: bool = False) -> DataFrame:
    """Feeds in argument order; ``ord.feed`` is the position of the feed."""
    return merge.union_feeds([read_feed(spark, p, schema, present) for p in paths])


def to_table(feed: DataFrame, path: str) -> None:
    """Store a feed with its order, split by marketplace and run; runs already there stay."""
    feed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("marketplace", "run_id").parquet(path)


def write_feed(records: DataFrame, path: str, compression: str | None = "gzip") -> None:
    drop = [c for c in ("ord", "page_error", "first_seen", "captures", "fetched_ts") if c in records.columns]
    records.drop(*drop).write.mode("overwrite").option("compression", compression or "none").json(path)


def write_validated(validated: DataFrame, path: str) -> None:
    serialise(validated).select("json").write.mode("overwrite").option("compression", "gzip").text(path)


def write_cards(card_lines: DataFrame, path: str) -> None:
    """Lines of ``report.card_json``."""
    card_lines.select("json").write.mode("overwrite").option("compression", "gzip").text(path)
