"""Queries that write a table the way a run leaves it behind and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.functions.values import lit
from shelfproof.operators import ranking, report, validate
from shelfproof.plans import shelf, views
from shelfproof.plans.registry import query
from shelfproof.sources import feeds, runs

ASIN = "CAST(p_partkey AS VARCHAR) AS asin"


@query("feed_round_trip", f"""
WITH r AS (SELECT 0 AS feed, * FROM part WHERE p_size <= 25 UNION ALL SELECT 1, * FROM part)
SELECT feed, {ASIN}, row_number() OVER (PARTITION BY feed ORDER BY p_partkey) AS place, p_brand AS brand,
       CASE WHEN p_type <> 'MEDIUM' THEN p_retailprice END AS price, p_type = 'MEDIUM' AS ranged, 'amazon.de' AS marketplace FROM r""")
def feed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds written as gzipped lines and read in argument order: records come in the order they were written."""
    listings = views.shelf_of(views.table(spark, sf, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"))
    folders = [views.scratch(spark, "feed") for _ in range(2)]
    feeds.write_feed(listings.join(views.table(spark, sf, "part").where("p_size <= 25").select(
        F.col("p_partkey").cast("string").alias("asin")), "asin", "left_semi").orderBy(F.col("asin").cast("long")), folders[0])
    feeds.write_feed(listings.orderBy(F.col("asin").cast("long")), folders[1])
    back = feeds.read_feeds(spark, folders, present=True)
    back = back.select(F.col("ord.feed").alias("feed"), "asin", "brand", F.col("price.amount").alias("price"),
                       F.array_contains("present_keys", "title").alias("_titled"), F.col("price.range").isNotNull().alias("ranged"),
                       "marketplace", F.col("ord.at").alias("at"))
    return ranking.numbered(back.where("_titled"), ["feed"], ["at"], "place").drop("at", "_titled")


@query("feed_table", f"""
SELECT {ASIN}, 'run' || p_size % 3 AS run_id, 'amazon.de' AS marketplace, p_brand AS brand FROM part WHERE p_size % 3 < 2
UNION ALL SELECT {ASIN}, 'run2', 'amazon.de', 'again' FROM part WHERE p_size % 3 = 2""")
def feed_table(spark: SparkSession, sf: str) -> DataFrame:
    """A feed stored by marketplace and run; a run stored again replaces itself, others stay."""
    part = views.table(spark, sf, "part")
    size = part.select(F.col("p_partkey").cast("string").alias("asin"), views.text("run", F.col("p_size") % 3).alias("_run"))
    records = views.shelf_of(part).drop("run_id").join(size, "asin").withColumnRenamed("_run", "run_id").select(
        "asin", "run_id", "marketplace", "brand", "title")
    folder = views.scratch(spark, "feed-table")
    feeds.to_table(records, folder)
    feeds.to_table(records.where("run_id = 'run2'").withColumn("brand", lit("again")), folder)
    return spark.read.parquet(folder).select("asin", "run_id", "marketplace", "brand")


@query("page_store_round_trip", """
SELECT 'A' || page_id AS asin, r AS run_id, '<i>' || page_id || '</i> 000-0000000-0000000' AS html FROM pages, (VALUES ('one'), ('two')) t(r)
WHERE r = 'one' OR page_id % 2 = 0""")
def page_store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs' pages stored one after the other and read back: identifiers are gone, both runs are there."""
    pages = views.table(spark, sf, "pages").select(
        views.text("A", F.col("page_id")).alias("asin"), "page_id",
        views.text("<i>", F.col("page_id"), "</i> 123-4567890-1234567").alias("html"))
    folder = views.scratch(spark, "page-store")
    for run, some in (("one", pages), ("two", pages.where("page_id % 2 = 0"))):
        empty = some.limit(1).select(lit("").alias("asin"), "html")
        runs.write_pages(some.select("asin", "html").unionByName(empty).withColumn("run_id", lit(run)), folder)
    return spark.read.parquet(folder).select("asin", "run_id", "html")


@query("manifest_round_trip", """
WITH e AS (SELECT event_type AS run_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'amazon.com' ELSE 'www.amazon.de' END AS marketplace,
             CASE event_type WHEN 'click' THEN 'en-GB,en' WHEN 'signup' THEN '' ELSE 'de-DE,de' END AS asked, count(*) AS n, max(user_id) AS top
           FROM events GROUP BY event_type)
SELECT run_id, coalesce(marketplace, '') AS marketplace, CASE WHEN asked = '' THEN NULL ELSE asked[1:2] END AS language,
       CASE WHEN asked = '' THEN 'unset' WHEN asked[1:2] = CASE WHEN marketplace = 'www.amazon.de' THEN 'de' ELSE 'en' END THEN 'matches'
            ELSE 'conflict' END AS status, CAST(n AS VARCHAR) AS events, CAST(top AS VARCHAR) AS top FROM e""")
def manifest_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests with the last of each stat, written and read back, and whether the language asked for fits the shop."""
    events = views.table(spark, sf, "events")
    kind = F.col("event_type")
    manifests = events.select(kind.alias("run_id")).distinct().select(
        "run_id", F.when(F.col("run_id") == "view", lit("amazon.com")).when(F.col("run_id") != "error", lit("www.amazon.de"))
        .alias("marketplace"), F.struct(
            F.when(F.col("run_id") == "click", lit("en-GB,en")).when(F.col("run_id") != "signup", lit("de-DE,de")).otherwise(lit(""))
            .alias("accept_language")).alias("locale"))
    counted = events.groupBy(kind.alias("run_id")).agg(F.count(lit(1)).alias("n"))
    stats = counted.select("run_id", lit("events").alias("key"), F.col("n").cast("string").alias("value"), F.col("n").alias("ord")).unionByName(
        events.select(kind.alias("run_id"), lit("top").alias("key"), F.col("user_id").cast("string").alias("value"),
                      F.col("user_id").alias("ord"))).unionByName(
        counted.select("run_id", lit("none").alias("key"), lit(None).cast("string").alias("value"), lit(0).cast("bigint").alias("ord")))
    folder = views.scratch(spark, "manifests")
    runs.write_manifests(manifests, stats, folder)
    back = runs.tag_locale(runs.read_manifests(spark, folder))
    stat = lambda k: F.try_element_at("stats", lit(k))
    return back.select("run_id", F.coalesce("marketplace", lit("")).alias("marketplace"), "locale_check.language", "locale_check.status",
                       stat("events").alias("events"), stat("top").alias("top"))


@query("sighting_log_round_trip", """
SELECT event_type AS query, count(*) AS sightings, count(DISTINCT user_id) AS products, count(*) FILTER (value > 40) AS sponsored,
       max(event_id) AS last FROM events GROUP BY event_type""")
def sighting_log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A sighting log written as lines and read back; counted per query."""
    folder = views.scratch(spark, "sightings")
    views.table(spark, sf, "events").select(
        F.col("event_type").alias("query"), F.col("user_id").cast("string").alias("asin"), F.col("event_id").cast("int").alias("position"),
        (F.col("value") > 40).alias("sponsored"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("seen_at")
    ).write.option("compression", "gzip").json(folder)
    log = runs.read_sightings(spark, folder)
    products = log.select("query", "asin").distinct().groupBy("query").agg(F.count("asin").alias("products"))
    return log.groupBy("query").agg(F.count(lit(1)).alias("sightings"), F.count_if("sponsored").alias("sponsored"),
                                    F.max("position").cast("bigint").alias("last")).join(products, "query")


@query("validated_lines", shelf.SHELF_SQL + f"""
SELECT {ASIN}, 1 AS contract, q_status AS quantity_status, total AS quantity, p_status AS price_status, round(p_value, 6) AS price,
       '' AS query FROM shelf""")
def validated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Validated records written as gzipped JSON lines; their values read back from the lines."""
    folder = views.scratch(spark, "validated")
    feeds.write_validated(validate.validate(views.shelf(spark, sf), shelf.PROFILE), folder)
    return spark.read.json(folder, schema=(
        "asin string, contract_version int, query string, quantity struct<status: string, value: double>,"
        " price_per_base struct<status: string, value: double>")).select(
        "asin", F.col("contract_version").alias("contract"), F.col("quantity.status").alias("quantity_status"),
        F.col("quantity.value").alias("quantity"), F.col("price_per_base.status").alias("price_status"),
        F.round("price_per_base.value", 6).alias("price"), "query")


@query("card_lines", shelf.SHELF_SQL + f"""
SELECT {ASIN}, 'shelf' AS category_key, category, p_status AS price_status, q_status AS quantity_status,
       CASE WHEN coloured THEN 'trusted' ELSE 'not_claimed' END AS coloured FROM shelf""")
def card_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cards written as gzipped JSON lines; their axes and claims read back from the lines."""
    folder = views.scratch(spark, "cards")
    feeds.write_cards(report.card_json(shelf.cards(spark, sf)), folder)
    status = "map<string, struct<status: string>>"
    return spark.read.json(folder, schema=(
        f"asin string, category_key string, category struct<text: string>, axes {status}, claims {status}")).select(
        "asin", "category_key", F.col("category.text").alias("category"),
        F.try_element_at("axes", lit("price_per_base"))["status"].alias("price_status"),
        F.try_element_at("axes", lit("quantity"))["status"].alias("quantity_status"),
        F.try_element_at("claims", lit("coloured"))["status"].alias("coloured"))
