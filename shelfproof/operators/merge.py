"""Several crawls, one record per product: the freshest capture wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.functions.values import lit
from shelfproof.functions.text import timestamp


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Feeds in argument order; a column one of them lacks is NULL there.

    ``ord`` orders records first by feed, then as the feed was read.
    """
    tagged = [f.withColumn("ord", F.struct(lit(i).alias("feed"), F.col("ord").alias("at")))
              for i, f in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def stamp_captures(feed: DataFrame, stamp: str = "fetched_at") -> DataFrame:
    """Add ``fetched_ts``; a missing or unreadable stamp is older than any other."""
    return feed.withColumn("fetched_ts", timestamp(F.col(stamp)))


def merge_key(keys=("asin",), order: str = "ord") -> Column:
    """The merge key as one string; a record without an id is a key of its own."""
    ids = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), lit("")) for k in keys])
    has_id = F.coalesce(F.col(keys[-1]).cast("string") != "", lit(False))
    return F.when(has_id, ids).otherwise(F.concat(lit("\x1e"), F.to_json(F.struct(order))))


def freshest(captures: DataFrame, keys=("asin",), stamp: str = "fetched_ts",
             order: str = "ord") -> DataFrame:
    """The newest capture per key; equal stamps keep the first seen.

    The wide rows move once, after each map task kept one row per key (limited
    rank), so a key with very many captures never gathers in one task.  The
    first-seen position and the number of captures come from a narrow,
    map-side combined aggregate on the same key.
    """
    keyed = captures.withColumn("_key", merge_key(keys, order))
    newest = Window.partitionBy("_key").orderBy(F.col(stamp).desc_nulls_last(), F.col(order).asc())
    winners = keyed.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    seen = keyed.groupBy("_key").agg(F.min(order).alias("first_seen"),
                                     F.count(lit(1)).alias("captures"))
    return winners.join(seen, "_key").drop("_key")


def provenance(captures: DataFrame, keys=("asin",), order: str = "ord",
               feed: Column | None = None) -> DataFrame:
    """One row: records kept, feeds read, keys that had more than one capture."""
    per_key = captures.groupBy(merge_key(keys, order).alias("_key")).agg(F.count(lit(1)).alias("n"))
    totals = per_key.agg(F.count(lit(1)).alias("records"),
                         F.count_if(F.col("n") > 1).alias("superseded"))
    feeds = captures.select((feed if feed is not None else F.col(order)["feed"]).alias("f")) \
                    .distinct().agg(F.count(lit(1)).alias("feeds"))
    both = totals.unionByName(feeds, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("records", "feeds", "superseded")])


def lineage(pages: DataFrame, feed: DataFrame, fields: list[str], key: str = "asin") -> DataFrame:
    """Give pages the provenance of the crawl that found them.

    Of several feed rows of a key the last by ``ord`` counts, alone; rows without a key count for none.  A
    field that row has wins, also when it is NULL there; a field it lacks, by ``present_keys`` of
    ``feeds.read_feed``, and every field of a page without a feed row stay the page's own.  The feed is reduced
    on the map side before the join.
    """
    if "ord" not in feed.columns:
        raise ValueError("a feed needs ord to say which of a key's records is the last")
    present = F.col("present_keys") if "present_keys" in feed.columns else F.array(*map(lit, fields))
    row = F.struct(*[F.col(f) for f in fields], present.alias("_present"))
    crawl = feed.where(F.col(key).cast("string") != "").groupBy(key).agg(F.max_by(row, "ord").alias("_crawl"))
    joined = pages.join(crawl, key, "left")
    own = {f: F.col(f) if f in pages.columns else lit(None) for f in fields}
    return joined.withColumns({f: F.when(F.array_contains("_crawl._present", lit(f)), F.col("_crawl")[f])
                               .otherwise(own[f]) for f in fields}).drop("_crawl")


def unseen(pages: DataFrame, feed: DataFrame, key: str = "asin") -> DataFrame:
    """Pages no feed row mentions."""
    return pages.join(feed.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def missing_ids(wanted: DataFrame, listings: DataFrame, key: str = "asin") -> DataFrame:
    """Ids asked for that no listing has."""
    return wanted.join(listings.select(key), key, "left_anti")


def pick(listings: DataFrame, ids: list[str], key: str = "asin") -> DataFrame:
    """Point lookup; the ``IN`` list reaches the Parquet scan."""
    return listings.where(F.col(key).isin(*ids))
