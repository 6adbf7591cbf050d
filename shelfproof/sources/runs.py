"""Run folders: manifests, page stores and sighting logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.functions import labels as LB
from shelfproof.functions.values import lit
from shelfproof.operators import pages as P
from shelfproof.schema import RUN, SIGHTING


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest; ``stats`` stays an open map.

    A file holds one manifest over many lines, as a crawl leaves it, or one a line, as ``write_manifests`` does.  Only
    between manifests does a closing brace end a line without a comma.
    """
    text = F.regexp_replace(F.trim("value"), r"\}\s*\n\s*\{", "},{")
    found = F.from_json(F.concat(lit("["), text, lit("]")), T.ArrayType(RUN), {"mode": "FAILFAST"})
    return spark.read.text(path, wholetext=True).where(F.trim("value") != "").select(
        F.explode(found).alias("run")).select("run.*")


def run_stats(runs: DataFrame) -> DataFrame:
    """Manifest stats as (run_id, key, value)."""
    return runs.select("run_id", F.explode("stats"))


def write_manifests(runs: DataFrame, stats: DataFrame, path: str) -> None:
    """Manifests with their scalar stats, one JSON line per run.

    ``stats`` is (run_id, key, value).  It is reduced to one row per stat before
    the map of a run is built, so a map is as large as the list of stat names.  Of a stat given
    more than once the last by ``ord`` counts; without an order the largest number, then the last text.
    """
    rank = F.col("ord") if "ord" in stats.columns else F.struct(
        F.col("value").cast("string").try_cast("double").alias("number"), F.col("value").cast("string").alias("text"))
    last = stats.where(F.col("value").isNotNull()).groupBy("run_id", "key").agg(F.max_by("value", rank).alias("value"))
    maps = last.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("key", F.col("value").cast("string").alias("value"))))).alias("stats"))
    runs.drop("stats").join(maps, "run_id", "left").write.mode("overwrite").json(path)


def tag_locale(runs: DataFrame) -> DataFrame:
    """Does the language a run asked for fit its marketplace?"""
    return runs.withColumn("locale_check", LB.locale_status(
        F.col("locale.accept_language"), LB.profile(F.col("marketplace"))["language"]))


def read_pages(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """A page store of ``<id>.html.gz`` files; the id is the file name, the time its last write."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html\.gz$", 1)
    return (spark.read.text(folder, wholetext=True, pathGlobFilter="*.html.gz")
            .select(name.alias("asin"), lit(run_id).cast("string").alias("run_id"), F.col("value").alias("html"),
                    F.date_format(F.date_trunc("second", F.col("_metadata.file_modification_time")),
                                  "yyyy-MM-dd'T'HH:mm:ssXXX").alias("fetched_at")))


def write_pages(pages: DataFrame, path: str) -> None:
    """Page table with identifiers redacted, one folder per run; runs already there stay."""
    P.redact_pages(pages.where((F.col("asin") != "") & (F.col("html") != ""))) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGHTING).json(path)


def stream_sightings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SIGHTING).json(folder)
