"""Queries over the shelf: merge, pack size, price, offers, ranking, comparison, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.categories import base as B
from shelfproof.functions import values as V
from shelfproof.functions.values import lit
from shelfproof.operators import merge, pricing, quantity, ranking, report, search, validate, variation
from shelfproof.operators.validate import Profile
from shelfproof.plans import views
from shelfproof.plans.registry import query

# --- merge -----------------------------------------------------------------------

CAPTURES_SQL = """
WITH captures AS (
  SELECT CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS asin,
         CASE WHEN event_type <> 'error' THEN ts END AS stamp, event_id, event_type, value,
         CASE WHEN event_type <> 'signup' THEN 'u' || user_id ELSE 'e' || event_id END AS k
  FROM events)
"""


@query("freshest_merge", CAPTURES_SQL + """
SELECT asin, event_id, event_type, value, first_seen, captures FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY stamp DESC NULLS LAST, event_id) AS r,
         min(event_id) OVER (PARTITION BY k) AS first_seen, count(*) OVER (PARTITION BY k) AS captures
  FROM captures) WHERE r = 1""")
def freshest_merge(spark: SparkSession, sf: str) -> DataFrame:
    feed = merge.stamp_captures(views.captures(spark, sf))
    return merge.freshest(feed).select("asin", "event_id", "event_type", "value", "first_seen", "captures")


@query("merge_provenance", CAPTURES_SQL + """
SELECT count(*) AS records, (SELECT count(DISTINCT event_type) FROM captures) AS feeds,
       count(*) FILTER (n > 1) AS superseded
FROM (SELECT k, count(*) AS n FROM captures GROUP BY k)""")
def merge_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return merge.provenance(views.captures(spark, sf), feed=F.col("event_type"))


# --- pack size and price -------------------------------------------------------------

BAND = (200.0, 5000.0)
PROFILE = Profile("shelf", "shelf", {}, BAND)

SHELF_SQL = """
WITH base AS (
  SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS bn, p_size * 100::DOUBLE AS said,
         CASE p_type WHEN 'PROMO' THEN p_size * 110::DOUBLE WHEN 'STANDARD' THEN p_size * 300::DOUBLE
                     ELSE p_size * 100::DOUBLE END AS total,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 1
                     WHEN 'PROMO' THEN CASE WHEN p_size > 1 THEN 2 ELSE 1 END ELSE 0 END AS n_hints,
         CASE p_type WHEN 'ECONOMY' THEN p_name || ' ' || p_size || ' x 100 g'
                     WHEN 'PROMO' THEN p_name || ' 100 g (' || p_size || 'er Pack)'
                     WHEN 'STANDARD' THEN p_name || ' ' || p_size || ' Packungen mit 100 g'
                     WHEN 'SMALL' THEN p_name || ' ' || (p_size * 100) || ' g' ELSE p_name END AS title,
         CASE WHEN p_type <> 'MEDIUM' THEN p_retailprice END AS amount,
         p_retailprice / (p_size * 100::DOUBLE / 1000::DOUBLE) AS per_kg
  FROM part),
packed AS (
  SELECT *, CASE WHEN p_type NOT IN ('ECONOMY','PROMO','STANDARD','SMALL','MEDIUM') THEN 'disputed'
                 WHEN n_hints > 0 AND abs(said - total) / greatest(said, total) <= 0.15 THEN 'trusted'
                 WHEN n_hints > 0 THEN 'disputed' WHEN p_type = 'SMALL' THEN 'trusted'
                 ELSE 'unverified' END AS q_status,
         CASE WHEN bn <= 8 THEN per_kg WHEN bn <= 16 THEN per_kg * 2 WHEN bn <= 20 THEN per_kg / 10::DOUBLE * 10::DOUBLE END AS published,
         amount / (total / 1000::DOUBLE) AS derived
  FROM base),
priced AS (
  SELECT *, round(coalesce(derived, published), 2) AS p_value,
         CASE WHEN derived IS NULL AND published IS NULL THEN 'unknown'
              WHEN q_status = 'disputed' THEN 'disputed'
              WHEN abs(published - derived) / greatest(published, derived) > 0.12
                   THEN CASE WHEN q_status = 'trusted' THEN 'trusted' ELSE 'disputed' END
              WHEN published IS NOT NULL AND derived IS NOT NULL THEN 'trusted'
              WHEN q_status = 'trusted' THEN 'trusted' ELSE 'unverified' END AS raw_status
  FROM packed),
shelf AS (
  SELECT *, CASE WHEN raw_status NOT IN ('disputed', 'unknown') AND (p_value < 200 OR p_value > 5000)
                 THEN 'disputed' ELSE raw_status END AS p_status,
         CASE WHEN p_type = 'LARGE' THEN 'other' ELSE 'shelf' END AS category,
         regexp_matches(title, 'red|blue') AS coloured,
         '{"family":"' || p_brand || '","signature":["' || lower(p_type) || '"]}' AS offer
  FROM priced)
"""


@query("quantity_reconcile", SHELF_SQL + """
SELECT CAST(p_partkey AS VARCHAR) AS asin, total, q_status AS status, n_hints,
       CASE WHEN n_hints > 0 THEN said END AS consensus FROM shelf""")
def quantity_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    shelf = views.shelf(spark, sf).withColumn("hints", quantity.listing_hints()) \
        .withColumn("bare", quantity.listing_bare_weights())
    checked = shelf.withColumn("q", quantity.reconcile(F.col("package"), F.col("hints"), F.col("bare")))
    return checked.select("asin", F.col("q.value").alias("total"), F.col("q.status").alias("status"),
                          F.size("hints").alias("n_hints"), quantity.consensus(F.col("hints")).alias("consensus"))


@query("bare_weights", SHELF_SQL + """
SELECT CAST(p_partkey AS VARCHAR) AS asin, CASE WHEN p_type = 'SMALL' OR single THEN 1 ELSE 0 END AS weights,
       CASE WHEN p_type = 'SMALL' OR single THEN said END AS first_grams,
       p_type IN ('ECONOMY', 'PROMO', 'STANDARD') AND p_size > 1 AS counted
FROM (SELECT *, p_type IN ('ECONOMY', 'PROMO', 'STANDARD') AND p_size = 1 AS single FROM shelf)""")
def bare_weights(spark: SparkSession, sf: str) -> DataFrame:
    shelf = views.shelf(spark, sf)
    texts = quantity.statement_texts(F.col("title"), F.col("package.size_name"), lit(""),
                                     F.col("content.feature_bullets"), F.col("content.description"))
    out = shelf.withColumn("texts", texts).withColumn("bare", quantity.listing_bare_weights()) \
        .withColumn("counted", quantity.states_pack_count(F.col("texts"), F.col("package.item_count")))
    return out.select("asin", F.size("bare").alias("weights"),
                                     F.get("bare", lit(0))["grams"].alias("first_grams"), "counted")


@query("price_value", SHELF_SQL + """
SELECT CAST(p_partkey AS VARCHAR) AS asin, amount AS value,
       CASE WHEN amount IS NULL THEN 'unknown' ELSE 'trusted' END AS status,
       CASE WHEN amount IS NULL THEN 'price.range' ELSE 'price' END AS field FROM shelf""")
def price_value(spark: SparkSession, sf: str) -> DataFrame:
    v = views.shelf(spark, sf).withColumn("v", pricing.price(F.col("price")))
    return v.select("asin", "v.value", "v.status", F.get("v.evidence", lit(0))["field"].alias("field"))


@query("price_per_base_band", SHELF_SQL + """
SELECT CAST(p_partkey AS VARCHAR) AS asin, p_value AS value, p_status AS status,
       CASE WHEN p_status = 'unknown' THEN '' ELSE 'EUR/kg' END AS unit,
       coalesce(p_status = 'disputed' AND n_hints > 0
                AND abs(p_value - amount / (said / 1000::DOUBLE)) / greatest(p_value, amount / (said / 1000::DOUBLE)) > 0.12,
                false) AS has_alternative
FROM shelf""")
def price_per_base_band(spark: SparkSession, sf: str) -> DataFrame:
    v = validate.validate(views.shelf(spark, sf), PROFILE).select("asin", "price_per_base")
    return v.select("asin", "price_per_base.value", "price_per_base.status", "price_per_base.unit", F.exists(
        "price_per_base.notes", lambda n: n.startswith("with the pack size")).alias("has_alternative"))


@query("validated_json")
def validated_json(spark: SparkSession, sf: str) -> DataFrame:
    return validate.serialise(validate.validate(views.shelf(spark, sf), PROFILE))


# --- families and offers ----------------------------------------------------------------

@query("variation_offers", """
WITH named AS (SELECT p_partkey, p_brand, lower(p_name) AS n FROM part),
placed AS (
  SELECT p.p_partkey, coalesce(q.p_brand, p.p_brand) AS family, coalesce('next ' || q.n, p.n) AS signature
  FROM named p LEFT JOIN named q ON q.p_partkey = p.p_partkey - 1)
SELECT family, signature, count(*) AS listings, min(p_partkey) AS first_listing FROM placed GROUP BY family, signature
""")
def variation_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's matrix names itself and the next part; the first matrix to claim a part wins."""
    part = views.table(spark, sf, "part")
    key, after = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    records = views.listing(part, ord=F.col("p_partkey"), asin=key, title=F.col("p_name"), variation=views.shape(
        "variation", dimensions=F.array(lit("flavor_name"), lit("size_name")), parent_asin=F.col("p_brand"),
        values_by_asin=F.create_map(
            key, F.array(views.text(F.col("p_name"), ", 6x500g"), views.text(F.col("p_size"), "0 g")),
            after, F.array(views.text("Next ", F.col("p_name")), views.text(F.col("p_size"), "0 g")))))
    placed = variation.with_offers(records)
    return placed.groupBy(F.get_json_object("offer_id", "$.family").alias("family"),
                          F.get_json_object("offer_id", "$.signature[0]").alias("signature")).agg(
        F.count(lit(1)).alias("listings"), F.min("ord").alias("first_listing"))


# --- ranking ------------------------------------------------------------------------------

AXES = (B.Axis("price_per_base", "Price per kg", better="lower", tolerance=0.01), B.Axis("quantity", "Pack size"))
CLAIMS = (B.Claim("coloured", "Coloured", r"red|blue"),)


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """The shelf as cards: two axes, one claim; large parts are another category."""
    shelf = views.shelf(spark, sf).withColumn("_fields", search.text_fields())
    v = validate.validate(shelf, PROFILE)
    other = F.array_contains("breadcrumbs", "LARGE")
    return v.withColumns({
        "category_key": lit("shelf"),
        "category": V.value(text=F.when(other, lit("other")).otherwise(lit("shelf")), status=V.TRUSTED),
        "axes": B.value_map({"price_per_base": F.col("price_per_base"), "quantity": F.col("quantity")}),
        "claims": B.value_map({c.key: B.stated("_fields", c) for c in CLAIMS})}).drop("_fields")


RANK_SQL = SHELF_SQL + """,
matched AS (SELECT *, count(*) OVER (PARTITION BY offer) AS listings FROM shelf WHERE category = 'shelf' {extra}),
usable AS (SELECT *, row_number() OVER (PARTITION BY offer ORDER BY p_value, p_partkey) AS r
           FROM matched WHERE p_status = 'trusted'),
best AS (SELECT *, row_number() OVER (ORDER BY p_value, listings DESC, offer, p_partkey) AS position
         FROM usable WHERE r = 1)
"""


@query("rank_offers", RANK_SQL.replace("{extra}", "") + """
SELECT b.position, u.p_value AS value, 'EUR/kg' AS unit, u.p_brand AS brand, u.title, CAST(u.p_partkey AS VARCHAR) AS asin,
       u.offer AS offer_id, u.r = 1 AS is_best
FROM usable u JOIN best b USING (offer) WHERE b.position <= 20""")
def rank_offers(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank(cards(spark, sf), "price_per_base").drop("pack")


@query("rank_winners_with_claim", RANK_SQL.replace("{extra}", "AND coloured") + """
SELECT position, p_value AS value, 'EUR/kg' AS unit, p_brand AS brand, title, CAST(p_partkey AS VARCHAR) AS asin,
       CASE WHEN total >= 1000 THEN (total / 1000)::VARCHAR ELSE total::VARCHAR END AS amount, offer AS offer_id, listings,
       (SELECT count(*) - 1 FROM usable u WHERE u.offer = best.offer) AS folded
FROM best WHERE position <= 20""")
def rank_winners_with_claim(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.rank(cards(spark, sf), "price_per_base", require=("coloured",), fold=False)
    return out.withColumn("amount", F.regexp_extract("pack", r"^([\d.]+)", 1).cast("double").cast("string")).drop("pack")


@query("ranked_members", RANK_SQL.replace("{extra}", "") + """
SELECT offer AS offer_id, CAST(p_partkey AS VARCHAR) AS asin, p_value AS value, r AS rank FROM usable""")
def ranked_members(spark: SparkSession, sf: str) -> DataFrame:
    placed = ranking.place(ranking.matching(cards(spark, sf)), "price_per_base").where("is_usable")
    return ranking.numbered(placed, ["offer_id"], ["score", "ord"]).select(
        "offer_id", "asin", F.col("v.value").alias("value"), "rank")


@query("excluded_offers", RANK_SQL.replace("{extra}", "") + """
SELECT CAST(p_partkey AS VARCHAR) AS asin, offer AS offer_id, listings, p_status AS status FROM matched m
WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.offer = m.offer)""")
def excluded_offers(spark: SparkSession, sf: str) -> DataFrame:
    placed = ranking.place(ranking.matching(cards(spark, sf)), "price_per_base")
    return ranking.excluded(placed).select("asin", "offer_id", "listings", "status")


@query("excluded_head", RANK_SQL.replace("{extra}", "") + """,
gone AS (SELECT * FROM matched m WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.offer = m.offer))
SELECT CAST(p_partkey AS VARCHAR) AS asin, p_status AS status, (SELECT count(*) FROM gone) AS excluded_total
FROM gone ORDER BY listings DESC, offer, p_partkey LIMIT 10""")
def excluded_head(spark: SparkSession, sf: str) -> DataFrame:
    placed = ranking.place(ranking.matching(cards(spark, sf)), "price_per_base")
    return ranking.excluded_head(placed).drop("reason")


@query("offer_group", SHELF_SQL + "SELECT offer AS offer_id, count(*) AS listings FROM shelf GROUP BY offer")
def offer_group(spark: SparkSession, sf: str) -> DataFrame:
    return variation.offer_sizes(variation.with_offers(views.shelf(spark, sf)))


@query("point_lookup", "SELECT CAST(p_partkey AS VARCHAR) AS asin, p_brand AS brand FROM part WHERE p_partkey IN (7, 42, 111)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return merge.pick(views.shelf(spark, sf), ["7", "42", "111"]).select("asin", "brand")


# --- summary and comparison --------------------------------------------------------------------

@query("status_summary", SHELF_SQL + """,
m AS (SELECT * FROM shelf WHERE category = 'shelf')
SELECT 'classified' AS metric, 'records' AS key, count(*) AS n FROM shelf
UNION ALL SELECT 'classified', 'match', count(*) FROM m
UNION ALL SELECT 'classified', 'other', count(*) FROM shelf WHERE category = 'other'
UNION ALL SELECT 'axis price_per_base', p_status, count(*) FROM m GROUP BY p_status
UNION ALL SELECT 'axis quantity', q_status, count(*) FROM m GROUP BY q_status
UNION ALL SELECT 'claimed', 'coloured', count(*) FROM m WHERE coloured
UNION ALL SELECT 'listings', 'with a family', count(*) FROM m
UNION ALL SELECT 'listings', 'with a trusted axis', count(*) FROM m WHERE p_status = 'trusted'
UNION ALL SELECT 'listings', 'with a disputed axis', count(*) FROM m WHERE p_status = 'disputed' OR q_status = 'disputed'
UNION ALL SELECT 'offers', 'offers', count(DISTINCT offer) FROM m
UNION ALL SELECT 'offers', 'folded variants', count(*) - count(DISTINCT offer) FROM m""")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.summary(cards(spark, sf), AXES, CLAIMS)


@query("compare_pairs", SHELF_SQL + """,
paired AS (
  SELECT a.p_partkey AS la, b.p_partkey AS lb, a.p_value AS pa, b.p_value AS pb, a.p_status AS sa, b.p_status AS sb,
         a.total AS qa, b.total AS qb, a.q_status AS ta, b.q_status AS tb, a.coloured AS ca, b.coloured AS cb,
         CASE WHEN a.category = 'other' OR b.category = 'other' THEN 'other category'
              WHEN a.offer = b.offer THEN 'same offer' ELSE 'rivals' END AS state
  FROM shelf a JOIN shelf b ON b.p_partkey = a.p_partkey + 1),
rows AS (
  SELECT la, lb, 'axis' AS kind, 'price_per_base' AS key,
         CASE WHEN NOT (sa = 'trusted' AND sb = 'trusted') THEN 'blocked' WHEN abs(pa - pb) < 0.01 THEN 'same'
              ELSE 'different' END AS outcome,
         CASE WHEN sa = 'trusted' AND sb = 'trusted' AND abs(pa - pb) >= 0.01
              THEN CASE WHEN pa < pb THEN 'A' ELSE 'B' END END AS winner,
         CASE WHEN sa = 'trusted' AND sb = 'trusted' AND abs(pa - pb) >= 0.01
              THEN round(greatest(pa, pb) / least(pa, pb), 6) END AS ratio
  FROM paired WHERE state = 'rivals'
  UNION ALL
  SELECT la, lb, 'axis', 'quantity', CASE WHEN NOT (ta = 'trusted' AND tb = 'trusted') THEN 'blocked'
         WHEN qa = qb THEN 'same' ELSE 'different' END, NULL, NULL FROM paired WHERE state = 'rivals'
  UNION ALL
  SELECT la, lb, 'claim', 'coloured', 'stated by one', CASE WHEN ca THEN 'A' ELSE 'B' END, NULL
  FROM paired WHERE state = 'rivals' AND ca <> cb
  UNION ALL
  SELECT la, lb, 'pack', 'price_per_base', 'same offer',
         CASE WHEN sa = 'trusted' AND sb = 'trusted' THEN CASE WHEN pa <= pb THEN 'A' ELSE 'B' END
              WHEN sa = 'trusted' THEN 'A' WHEN sb = 'trusted' THEN 'B' END, NULL
  FROM paired WHERE state = 'same offer'
  UNION ALL
  SELECT la, lb, 'category', 'category', 'nothing to compare', NULL, NULL FROM paired WHERE state = 'other category')
SELECT CAST(la AS VARCHAR) AS left_asin, CAST(lb AS VARCHAR) AS right_asin, kind, key, outcome, winner, ratio FROM rows""")
def compare_pairs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    pairs = views.table(spark, sf, "part").select(key.cast("string").alias("left_asin"),
                                                  (key + 1).cast("string").alias("right_asin"))
    return report.compare(cards(spark, sf), pairs, AXES, CLAIMS, "price_per_base") \
        .withColumn("ratio", F.round("ratio", 6)).drop("reason")


@query("card_facts", SHELF_SQL + """
SELECT CAST(p_partkey AS VARCHAR) AS asin, 'axes' AS kind, 'price_per_base' AS key, p_status AS status, p_value AS value FROM shelf
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'axes', 'quantity', q_status, total FROM shelf
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'claims', 'coloured', CASE WHEN coloured THEN 'trusted' ELSE 'not_claimed' END,
                 CASE WHEN coloured THEN 1 ELSE 0 END FROM shelf""")
def card_facts(spark: SparkSession, sf: str) -> DataFrame:
    return report.facts(cards(spark, sf)).select("asin", "kind", "key", "v.status", "v.value")


class _Shelf:
    axes, claims = AXES, CLAIMS


@query("card_sections", SHELF_SQL + """,
m AS (SELECT * FROM shelf WHERE category = 'shelf')
SELECT CAST(p_partkey AS VARCHAR) AS asin, CASE WHEN p_status = 'trusted' THEN 'axis' ELSE 'not known' END AS section,
       'price_per_base' AS key, p_status AS status FROM m
UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE WHEN q_status = 'trusted' THEN 'axis' ELSE 'not known' END,
       'quantity', q_status FROM m
UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE WHEN coloured THEN 'claims' ELSE 'not claimed' END, 'coloured',
       CASE WHEN coloured THEN 'trusted' ELSE 'not_claimed' END FROM m""")
def card_sections(spark: SparkSession, sf: str) -> DataFrame:
    return report.sections(cards(spark, sf), _Shelf).drop("quote")


@query("card_json")
def card_json(spark: SparkSession, sf: str) -> DataFrame:
    return report.card_json(cards(spark, sf))
