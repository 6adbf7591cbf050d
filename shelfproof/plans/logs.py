"""Queries over logs, lineage and snapshots, and the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.functions.values import lit
from shelfproof.operators import merge, sightings, snapshot
from shelfproof.plans import views
from shelfproof.plans.registry import query
from shelfproof.streaming import jobs

# --- sightings ----------------------------------------------------------------------

LOG_SQL = """
WITH log AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS query, user_id AS asin, event_id, ts, value,
                    value > 40 AS sponsored FROM events)
"""


@query("sighting_stats", LOG_SQL + """
SELECT query, count(*) AS occurrences, count(DISTINCT asin) AS products, count(*) - count(DISTINCT asin) AS repeats,
       count(*) FILTER (sponsored) AS sponsored, round(count(*) FILTER (sponsored) / count(*)::DOUBLE, 6) AS sponsored_share
FROM log GROUP BY query""")
def sighting_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sightings.stats(views.sighting_log(spark, sf))


@query("shared_products", LOG_SQL + """
SELECT asin, count(DISTINCT query) AS queries, count(*) AS occurrences FROM log GROUP BY asin HAVING count(DISTINCT query) > 1""")
def shared_products(spark: SparkSession, sf: str) -> DataFrame:
    return sightings.shared_products(views.sighting_log(spark, sf))


@query("first_sightings", LOG_SQL + """
SELECT run_id, asin, query, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, asin ORDER BY ts, event_id) AS r FROM log) WHERE r = 1""")
def first_sightings(spark: SparkSession, sf: str) -> DataFrame:
    return sightings.first_sightings(views.sighting_log(spark, sf), order=("ts", "event_id")).select(
        "run_id", "asin", "query", "event_id")


@query("sighting_rank", LOG_SQL + """
SELECT event_id, row_number() OVER (PARTITION BY run_id, query ORDER BY ts, event_id) AS position FROM log""")
def sighting_rank(spark: SparkSession, sf: str) -> DataFrame:
    from shelfproof.operators import ranking
    return ranking.numbered(views.sighting_log(spark, sf).select("run_id", "query", "ts", "event_id"),
                            ["run_id", "query"], ["ts", "event_id"], "position").select("event_id", "position")


@query("normalised_sightings", """
SELECT event_id, round(value, 2) AS result_price_amount,
       CASE event_type WHEN 'click' THEN 'EUR' WHEN 'view' THEN 'USD' WHEN 'purchase' THEN 'GBP' ELSE 'EUR' END AS currency,
       CASE WHEN value > 40 THEN 'ad_holder' END AS marker, value > 40 AS sponsored,
       'Result (' || event_id || ')' AS result_title, event_type = 'click' AS in_result_grid FROM events""")
def normalised_sightings(spark: SparkSession, sf: str) -> DataFrame:
    kind, english = F.col("event_type"), F.format_number("value", 2)
    german = F.translate(english, ",.", ".,")
    price = F.when(kind == "view", F.concat(lit("$"), english)).when(kind == "purchase", F.concat(lit("&pound;"), english)) \
        .when(kind == "click", F.concat(german, lit("&nbsp;&euro;"))).otherwise(german)
    host = F.when(kind == "view", lit("www.amazon.com")).when(kind == "purchase", lit("amazon.co.uk")).otherwise(lit("amazon.de"))
    from shelfproof.functions import labels as LB
    raw = views.table(spark, sf, "events").select(
        "event_id", price.alias("result_price_text"), host.alias("marketplace"),
        views.text("Result ( ", F.col("event_id"), " )").alias("result_title"),
        F.when(kind == "click", lit(1)).alias("grid_position"),
        LB.sponsored_markers(F.when(F.col("value") > 40, lit("x AdHolder")), lit(False), lit(None)).alias("sponsored_markers"))
    out = sightings.normalise(raw)
    return out.select("event_id", "result_price_amount", "currency", F.get("sponsored_markers", lit(0)).alias("marker"),
                      "sponsored", "result_title", "in_result_grid")


# --- lineage and snapshots ---------------------------------------------------------------

@query("lineage_join", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN d.source
       WHEN l.toxic = 1 THEN NULL ELSE 'feed' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def lineage_join(spark: SparkSession, sf: str) -> DataFrame:
    """A field the feed has wins, also when it is NULL there."""
    pages = views.table(spark, sf, "documents").select("doc_id", "source", lit(-1).alias("quality"))
    feed = views.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") != 1, lit("feed")).alias("source"), "quality", F.col("doc_id").alias("ord"))
    return merge.lineage(pages, feed, ["source", "quality"], "doc_id")


@query("unseen_pages", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def unseen_pages(spark: SparkSession, sf: str) -> DataFrame:
    return merge.unseen(views.table(spark, sf, "documents").select("doc_id", "source"),
                        views.table(spark, sf, "labels"), "doc_id")


@query("missing_ids", """
SELECT o_custkey AS custkey FROM (SELECT DISTINCT o_custkey FROM orders) o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)""")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    wanted = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")).distinct()
    held = views.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return merge.missing_ids(wanted, held, "custkey")


@query("snapshot_diff", """
WITH e AS (SELECT * FROM part), a AS (SELECT p_partkey, p_brand, CASE WHEN p_type = 'SMALL' THEN upper(p_name) ELSE p_name END AS p_name,
           CASE WHEN p_size > 45 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_type <> 'LARGE')
SELECT e.p_partkey, 'p_name' AS path, e.p_name AS expected, a.p_name AS actual FROM e LEFT JOIN a USING (p_partkey)
  WHERE e.p_name IS DISTINCT FROM a.p_name
UNION ALL SELECT e.p_partkey, 'p_size', CAST(e.p_size AS VARCHAR), CAST(a.p_size AS VARCHAR) FROM e LEFT JOIN a USING (p_partkey)
  WHERE e.p_size IS DISTINCT FROM a.p_size
UNION ALL SELECT e.p_partkey, 'tags[' || i || ']', CASE i WHEN 0 THEN e.p_brand ELSE e.p_type END, NULL
  FROM e, (VALUES (0), (1)) t(i) WHERE e.p_type = 'LARGE'
UNION ALL SELECT e.p_partkey, 'tags[]', '2', CASE WHEN e.p_type <> 'LARGE' THEN '1' END FROM e
UNION ALL SELECT e.p_partkey, 'tags[1]', e.p_type, NULL FROM e WHERE e.p_type <> 'LARGE'""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    expected = part.select("p_partkey", "p_name", "p_size", F.array("p_brand", "p_type").alias("tags"))
    actual = part.where("p_type <> 'LARGE'").select(
        "p_partkey", F.when(F.col("p_type") == "SMALL", F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"),
        F.when(F.col("p_size") <= 45, F.col("p_size")).alias("p_size"), F.array("p_brand").alias("tags"))
    return snapshot.difference(expected, actual, "p_partkey")


# --- streams -----------------------------------------------------------------------------------

#: Files that the event log arrives in, one a batch.
PIECES = 4


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    """The event log in pieces that arrive one after the other; every seventh event arrives a piece late."""
    events = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = views.scratch(spark, "event-log")
    size = (events.agg(F.max("event_id")).first()[0] or 0) // PIECES + 1
    piece = F.least(F.floor(F.col("event_id") / size) + (F.col("event_id") % 7 == 3).cast("int"), lit(PIECES - 1))
    for n in range(PIECES):
        events.where(piece == n).write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, files // PIECES)).parquet(folder)


def _log_stream(stream: DataFrame) -> DataFrame:
    return stream.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.date_trunc("day", "ts").alias("run_started"),
        F.col("event_type").alias("query"), F.col("user_id").alias("asin"), "event_id", "ts", "value")


@query("stream_distinct_sightings", LOG_SQL + """
SELECT run_id, asin, query, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, asin ORDER BY ts, event_id) AS r FROM log) WHERE r = 1""")
def stream_distinct_sightings(spark: SparkSession, sf: str) -> DataFrame:
    """First sightings over several batches, late ones among them; runs that began a year ago are closed."""
    out = views.scratch(spark, "distinct-sightings")
    once = jobs.distinct_sightings(_log_stream(_arriving(spark, sf)), ["query", "event_id"], seen_at="ts", order="event_id",
                                   late="366 days")
    table = jobs.Merged(f"{out}/table", jobs.newest_of("run_id", "asin"), every=3)
    jobs.run_batches(once, f"{out}/checkpoint", table.write, "update").awaitTermination()
    return table.read(spark).select("run_id", "asin", "first.query", "first.event_id")


@query("stream_query_budget", """
WITH log AS (SELECT event_type AS query, user_id AS asin, min(event_id) AS first FROM events GROUP BY ALL),
owner AS (SELECT query, asin, first, row_number() OVER (PARTITION BY query ORDER BY first) AS place FROM log)
SELECT query, count(*) AS accepted FROM owner WHERE place <= 20 GROUP BY query""")
def stream_query_budget(spark: SparkSession, sf: str) -> DataFrame:
    """At most 20 new products per query; here every query keeps its own run, so products are not shared."""
    out = views.scratch(spark, "query-budget")
    log = _log_stream(_events_stream(spark, sf)).withColumn("run_id", F.col("query"))
    accepted = jobs.Merged(f"{out}/accepted", lambda rows: rows)
    jobs.run_batches(log, f"{out}/checkpoint", jobs.budget(accepted, 20, order="event_id")).awaitTermination()
    return accepted.read(spark).groupBy("query").agg(F.count(lit(1)).alias("accepted"))


@query("stream_shared_budget", LOG_SQL.replace("WITH", "WITH RECURSIVE", 1) + """,
first AS (SELECT run_id, query, asin, min(event_id) AS event_id FROM log GROUP BY ALL),
turn AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n FROM first),
read AS (
  SELECT run_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS products, CAST([] AS VARCHAR[]) AS queries,
         CAST(NULL AS BIGINT) AS event_id, false AS taken FROM (SELECT DISTINCT run_id FROM log)
  UNION ALL
  SELECT run_id, n, CASE WHEN fits THEN list_append(products, asin) ELSE products END,
         CASE WHEN fits THEN list_append(queries, query) ELSE queries END, event_id, fits FROM (
    SELECT t.run_id, t.n, r.products, r.queries, t.asin, t.query, t.event_id,
           NOT list_contains(r.products, t.asin) AND len(list_filter(r.queries, lambda q: q = t.query)) < 3 AS fits
    FROM read r JOIN turn t ON t.run_id = r.run_id AND t.n = r.n + 1))
SELECT t.run_id, t.query, t.asin, t.event_id FROM read r JOIN turn t ON t.run_id = r.run_id AND t.n = r.n WHERE r.taken""")
def stream_shared_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The same budget within one run, where a product counts for one query only."""
    out = views.scratch(spark, "shared-budget")
    accepted = jobs.Merged(f"{out}/accepted", lambda rows: rows)
    jobs.run_batches(_log_stream(_events_stream(spark, sf)), f"{out}/checkpoint",
                     jobs.budget(accepted, 3, order="event_id")).awaitTermination()
    return accepted.read(spark).select("run_id", "query", "asin", "event_id")


@query("stream_freshest", """
SELECT user_id, event_id, event_type, captures FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST, event_id) AS r,
         count(*) OVER (PARTITION BY user_id) AS captures FROM events) WHERE r = 1""")
def stream_freshest(spark: SparkSession, sf: str) -> DataFrame:
    """Freshest captures over several batches, late ones among them, without state in the stream."""
    out = views.scratch(spark, "freshest")
    feed = _arriving(spark, sf).withColumn("stamp", F.when(F.col("event_type") != "error", F.col("ts")))
    table = jobs.Merged(f"{out}/table", jobs.freshest_of("user_id"), every=3)

    def each(batch: DataFrame, batch_id: int) -> None:
        table.write(jobs.freshest(batch, "user_id", "stamp", "event_id", ["event_id", "event_type"]), batch_id)

    jobs.run_batches(feed, f"{out}/checkpoint", each).awaitTermination()
    return table.read(spark).select("user_id", "capture.event_id", "capture.event_type", "captures")


@query("stream_windows", """
WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) FILTER (event_type = 'error') AS errors,
                  count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1)
SELECT window_start, errors, purchases FROM w
WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows the watermark has closed once the log is read to its end."""
    out = views.scratch(spark, "windows")
    kind = F.col("event_type")
    counted = jobs.counters(_events_stream(spark, sf), "ts", {"errors": kind == "error", "purchases": kind == "purchase"},
                            window="1 hour", late="2 hours")
    jobs.run_to_table(counted, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{out}/table")


@query("stream_validation", """
SELECT p_type, count(*) AS listings, count(*) FILTER (p_type IN ('ECONOMY', 'PROMO', 'SMALL')) AS trusted,
       count(*) FILTER (p_type IN ('STANDARD', 'LARGE')) AS disputed FROM part GROUP BY p_type""")
def stream_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The batch trust pass, unchanged, over a stream of listings."""
    from shelfproof.operators.validate import validate
    out = views.scratch(spark, "validation")
    schema = views.table(spark, sf, "part").schema
    parts = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(sf)
    checked = validate(views.shelf_of(parts)).select(F.element_at("breadcrumbs", 2).alias("p_type"), F.col("quantity.status").alias("status"))
    jobs.run_to_table(checked, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(checked.schema).parquet(f"{out}/table").groupBy("p_type").agg(
        F.count(lit(1)).alias("listings"), F.count_if(F.col("status") == "trusted").alias("trusted"),
        F.count_if(F.col("status") == "disputed").alias("disputed"))
