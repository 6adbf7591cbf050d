"""Queries over measured facts: nutrition, ratings, review signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.functions.values import lit, unfold
from shelfproof.operators import nutrition, reviews
from shelfproof.plans import views
from shelfproof.plans.registry import query

BANDS = {"energy_kcal": (150.0, 480.0), "protein_g": (4.0, 48.0)}

NUTRIENTS_SQL = """
WITH lines AS (
  SELECT l_partkey AS asin, CASE least(l_linenumber, 5) WHEN 1 THEN 'protein_g' WHEN 2 THEN 'carbohydrates_g'
         WHEN 3 THEN 'fat_g' WHEN 4 THEN 'energy_kcal' ELSE 'salt_g' END AS key, l_quantity, l_returnflag FROM lineitem),
n AS (
  SELECT asin, key, CASE key WHEN 'energy_kcal' THEN max(l_quantity) * 10 WHEN 'fat_g' THEN min(l_quantity)
         ELSE max(l_quantity) END AS amount, min(l_returnflag) <> 'R' AS known FROM lines GROUP BY asin, key),
f AS (
  SELECT *, key IN ('protein_g', 'carbohydrates_g', 'fat_g') AS macro,
         coalesce((key = 'energy_kcal' AND (amount < 150 OR amount > 480) AND known)
                  OR (key = 'protein_g' AND (amount < 4 OR amount > 48) AND known), false) AS off
  FROM n),
g AS (
  SELECT asin, sum(CASE WHEN macro AND known THEN amount ELSE 0 END) AS mass,
         sum(CASE WHEN macro AND known THEN amount * CASE key WHEN 'fat_g' THEN 9 ELSE 4 END ELSE 0 END) AS implied,
         max(CASE WHEN key = 'energy_kcal' AND known THEN amount END) AS energy,
         count(*) FILTER (known) AS checkable, bool_or(off AND (macro OR key = 'energy_kcal')) AS band_hit
  FROM f GROUP BY asin),
j AS (
  SELECT f.*, mass, implied, checkable, mass > 105 AS heavy, band_hit,
         coalesce(implied <> 0 AND abs(implied - energy) / greatest(implied, energy) > 0.35, false) AS clash
  FROM f JOIN g USING (asin)),
checked AS (
  SELECT *, CASE WHEN NOT known THEN 'unknown' WHEN off OR (heavy AND macro) THEN 'disputed'
         WHEN (clash AND (macro OR key = 'energy_kcal') AND NOT (band_hit OR heavy)) OR checkable < 2 THEN 'unverified'
         ELSE 'trusted' END AS status
  FROM j)
"""


@query("nutrition_values", NUTRIENTS_SQL + """
SELECT asin, key, CASE WHEN known THEN amount END AS value, status, known AND clash AND (macro OR key = 'energy_kcal')
       AND NOT ((band_hit OR heavy) AND status <> 'disputed') AS contradiction FROM checked""")
def nutrition_values(spark: SparkSession, sf: str) -> DataFrame:
    """The nested rules: one block per part, built from one aggregate per part."""
    rows = views.nutrient_table(spark, sf)
    keys = list(views.NUTRIENT_LINES.values())
    wide = rows.groupBy("asin").agg(*[F.max(F.when(F.col("key") == k, F.struct("amount", "unit"))).alias(k) for k in keys])
    stated = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(
        lit(k).alias("key"), F.col(k)["amount"].alias("value"))) for k in keys]))
    lines = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(
        lit(k).alias("key"), lit(k).alias("label"), F.col(k)["amount"].alias("amount"), F.col(k)["unit"].alias("unit"),
        F.concat(F.col(k)["amount"].cast("string"), lit(" "), F.col(k)["unit"]).alias("value_text"),
        lit(True).alias("basis_confirmed"))) for k in keys]))
    blocks = wide.select("asin", F.struct(
        lit("nutrition_card").alias("source"), lit("100 g").alias("basis_text"), F.map_from_entries(stated).alias("per_100g"),
        lines.alias("rows"), F.expr("cast(array() as array<string>)").alias("derived")).alias("block"))
    checked = nutrition.validate(blocks, BANDS, "shelf", block="block")
    return unfold(checked, F.col("nutrition"), "e", "asin").select(
        "asin", "e.key", "e.v.value", "e.v.status",
        F.array_contains("e.v.flags", nutrition.CONTRADICTION).alias("contradiction"))


@query("nutrition_long", NUTRIENTS_SQL + """
SELECT asin, key, amount, status, mass, implied, checkable FROM checked""")
def nutrition_long(spark: SparkSession, sf: str) -> DataFrame:
    return nutrition.validate_long(views.nutrient_table(spark, sf), limits=BANDS).drop("unit")


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    stars = views.star_counts(spark, sf)
    shares = F.create_map(*[x for i, k in ((5, "five_star"), (4, "four_star"), (3, "three_star"), (2, "two_star"),
                                           (1, "one_star"))
                            for x in (lit(k), F.round(F.col(f"c{i}") * 100.0 / F.col("n"), 0).cast("int"))])
    value = F.round(F.col("stars") / F.col("n"), 1) + F.when(F.col("c1") > F.col("c2"), 0.5).otherwise(0.0)
    return stars.select("asin", "n", shares.alias("histogram"), F.struct(
        value.alias("value"), F.col("n").alias("count"), value.cast("string").alias("text")).alias("rating"))


RATED_SQL = """
WITH s AS (
  SELECT l_partkey AS asin, count(*) AS n, sum(least(l_linenumber, 5)) AS stars,
         count(*) FILTER (l_linenumber = 1) AS c1, count(*) FILTER (l_linenumber = 2) AS c2,
         count(*) FILTER (l_linenumber = 3) AS c3, count(*) FILTER (l_linenumber = 4) AS c4,
         count(*) FILTER (l_linenumber >= 5) AS c5 FROM lineitem GROUP BY l_partkey),
h AS (
  SELECT *, CAST(round(c1 * 100::DOUBLE / n) AS INT) AS p1, CAST(round(c2 * 100::DOUBLE / n) AS INT) AS p2,
         CAST(round(c3 * 100::DOUBLE / n) AS INT) AS p3, CAST(round(c4 * 100::DOUBLE / n) AS INT) AS p4,
         CAST(round(c5 * 100::DOUBLE / n) AS INT) AS p5,
         round(stars / n, 1) + CASE WHEN c1 > c2 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS value FROM s),
r AS (SELECT *, p1 + p2 + p3 + p4 + p5 AS total, (p1 + 2*p2 + 3*p3 + 4*p4 + 5*p5) / (p1 + p2 + p3 + p4 + p5)::DOUBLE AS implied
      FROM h)
"""


@query("histogram_rating", RATED_SQL + """
SELECT asin, value, round(implied, 6) AS implied, total AS covered,
       CASE WHEN total < 98 OR total > 102 THEN 'disputed' WHEN abs(implied - value) > 0.25 THEN 'disputed'
            WHEN n < 20 THEN 'unverified' ELSE 'trusted' END AS status FROM r""")
def histogram_rating(spark: SparkSession, sf: str) -> DataFrame:
    rated = _rated(spark, sf).withColumn("v", reviews.rating(F.col("rating"), F.col("histogram")))
    return rated.select("asin", "v.value", F.round(reviews.implied_average(F.col("histogram")), 6).alias("implied"),
                        reviews.covered(F.col("histogram")).alias("covered"), "v.status")


@query("negative_share", RATED_SQL + """
SELECT asin, CASE WHEN total BETWEEN 98 AND 102 THEN p1 + p2 END AS value,
       CASE WHEN total NOT BETWEEN 98 AND 102 THEN 'unknown' WHEN n < 20 THEN 'unverified' ELSE 'trusted' END AS status FROM r""")
def negative_share(spark: SparkSession, sf: str) -> DataFrame:
    v = _rated(spark, sf).withColumn("v", reviews.negative_share(F.col("rating"), F.col("histogram")))
    return v.select("asin", "v.value", "v.status")


# Letters only, so the same pattern means the same in both engines.
SIGNALS = [("praised", r"(?i)tion", 4.0, None), ("criticised", r"(?i)ein|ver", None, 2.0), ("mentioned", r"(?i)que", None, None)]


@query("review_signals", """
WITH cards AS (SELECT conv_id, turn, text, 5 - least(turn, 4) AS rating FROM conversations),
hits AS (
  SELECT conv_id, 'praised' AS signal FROM cards WHERE rating >= 4 AND regexp_matches(text, 'tion', 'i')
  UNION ALL SELECT conv_id, 'criticised' FROM cards WHERE rating <= 2 AND regexp_matches(text, 'ein|ver', 'i')
  UNION ALL SELECT conv_id, 'mentioned' FROM cards WHERE regexp_matches(text, 'que', 'i')),
n AS (SELECT conv_id, signal, least(count(*), 3) AS hits FROM hits GROUP BY conv_id, signal)
SELECT a.conv_id, s.signal, coalesce(n.hits, 0) AS hits, CASE WHEN n.hits > 0 THEN 'unverified' ELSE 'unknown' END AS status
FROM (SELECT DISTINCT conv_id FROM conversations) a
CROSS JOIN (VALUES ('praised'), ('criticised'), ('mentioned')) s(signal)
LEFT JOIN n ON n.conv_id = a.conv_id AND n.signal = s.signal""")
def review_signals(spark: SparkSession, sf: str) -> DataFrame:
    cards = views.table(spark, sf, "conversations").withColumn("rating", (5 - F.least("turn", lit(4))).cast("double"))
    return reviews.signal_hits(cards, SIGNALS, "conv_id", "turn")


@query("review_sample_caveats", """
SELECT conv_id, count(*) AS cards, count(*) FILTER (role = 'assistant') AS not_bought,
       count(DISTINCT role) AS variants, count(*) FILTER (role = 'system') AS foreign_cards,
       CASE WHEN count(DISTINCT role) > 1 THEN true ELSE false END AS pooled
FROM conversations GROUP BY conv_id""")
def review_sample_caveats(spark: SparkSession, sf: str) -> DataFrame:
    """Caveats of a sample from a long card table: counts only, no card is gathered."""
    return views.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(lit(1)).alias("cards"), F.count_if(F.col("role") == "assistant").alias("not_bought"),
        F.count_distinct("role").alias("variants"), F.count_if(F.col("role") == "system").alias("foreign_cards"),
        (F.count_distinct("role") > 1).alias("pooled"))
