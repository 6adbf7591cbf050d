"""Queries over the three categories: listings written from ``part`` rows, judged by the category's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof import categories  # noqa: F401  registers the categories
from shelfproof.categories import base as B
from shelfproof.functions.values import lit, unfold
from shelfproof.operators import quantity, report
from shelfproof.operators.validate import validate
from shelfproof.plans import views
from shelfproof.plans.registry import query


def _cases(column: str, values: dict):
    out = None
    for key, v in values.items():
        v = v if hasattr(v, "alias") else lit(v)
        out = F.when(F.col(column) == key, v) if out is None else out.when(F.col(column) == key, v)
    return out


def _common(part: DataFrame, **columns) -> DataFrame:
    size = F.col("p_size")
    return views.listing(
        part, ord=F.col("p_partkey"), asin=F.col("p_partkey").cast("string"), marketplace=lit("amazon.de"),
        price=views.shape("price", amount=F.floor("p_retailprice") / 100, currency=lit("EUR")),
        package=views.shape("package", total_quantity_base=lit(1000.0), total_quantity_unit=lit("g"),
                            total_quantity_source=lit("unit_count")),
        rating=views.shape("rating", count=lit(100)),
        **{"brand": F.col("p_brand"), "reviews": views.shape("reviews", histogram_percent=F.create_map(
            lit("five_star"), 100 - size, lit("one_star"), size)), **columns})


def pasta(spark: SparkSession, sf: str) -> DataFrame:
    shelf = F.array(lit("Lebensmittel"), lit("Nudeln & Pasta"))
    bullets = F.array(_cases("p_type", {"STANDARD": "Frische Pasta aus dem Kühlregal", "LARGE": "Aus 100% Hartweizen"}),
                      F.when(views.brand_number() <= 10, lit("Bronze gezogen und langsam getrocknet.")))
    return _common(
        views.spread(views.table(spark, sf, "part")), title=views.text("Spaghetti ", F.col("p_name"), " 1 kg"),
        breadcrumbs=F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "LARGE"), shelf)
        .when(F.col("p_type") == "PROMO", F.array(lit("Nudeln & Pasta"), lit("Konserven")))
        .when(F.col("p_type") == "MEDIUM", F.array(lit("Werkzeug"))),
        content=views.shape("content", feature_bullets=F.array_compact(bullets)),
        food=views.shape("food", ingredients=F.struct(F.when(F.col("p_type") == "LARGE", lit(
            "HARTWEIZENGRIEß, Eier")).alias("text"), lit("nutrition_card").alias("source"))))


@query("pasta_cards", """
WITH p AS (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS bn, p_type IN ('ECONOMY', 'LARGE') AS m FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS asin, CASE WHEN m THEN 'dry_pasta' WHEN p_type <> 'SMALL' THEN 'other' END AS category,
       CASE WHEN p_type = 'SMALL' THEN 'unknown' ELSE 'trusted' END AS status,
       CASE WHEN p_type = 'LARGE' THEN 'durum_wheat,egg' END AS materials,
       CASE WHEN p_type = 'LARGE' THEN 'trusted' WHEN m THEN 'unknown' END AS materials_status,
       CASE WHEN m THEN CASE WHEN bn <= 10 THEN 2 ELSE 0 END ELSE 0 END AS claimed,
       CASE WHEN p_type = 'LARGE' THEN 'disputed' END AS pure_durum,
       CASE WHEN m THEN floor(p_retailprice) / 100 END AS price FROM p""")
def pasta_cards(spark: SparkSession, sf: str) -> DataFrame:
    cards = B.evaluate(pasta(spark, sf), B.get("dry_pasta"))
    at = lambda c, k: F.try_element_at(c, lit(k))
    return cards.select(
        "asin", F.col("category.text").alias("category"), F.col("category.status").alias("status"),
        at("axes", "raw_materials")["text"].alias("materials"), at("axes", "raw_materials")["status"].alias("materials_status"),
        F.size(F.filter(F.map_values("claims"), lambda v: v["status"] == "trusted")).alias("claimed"),
        at("claims", "pure_durum")["status"].alias("pure_durum"), at("axes", "price_per_base")["value"].alias("price"))


@query("pasta_axes", """
WITH m AS (SELECT *, CAST(p_partkey AS VARCHAR) AS asin FROM part WHERE p_type IN ('ECONOMY', 'LARGE'))
SELECT asin, 'raw_materials' AS key, CASE WHEN p_type = 'LARGE' THEN 'durum wheat, egg' END AS shown,
       CASE WHEN p_type = 'LARGE' THEN 'trusted' ELSE 'unknown' END AS status FROM m
UNION ALL SELECT asin, 'quantity', '1000 g', 'trusted' FROM m
UNION ALL SELECT asin, a, NULL, 'absent' FROM m, (VALUES ('protein_g'), ('energy_kcal'), ('fiber_g')) t(a)""")
def pasta_axes(spark: SparkSession, sf: str) -> DataFrame:
    """What a card shows of each axis: a list of materials in words, a number with its unit, nothing."""
    category = B.get("dry_pasta")
    return report.shown_axes(B.evaluate(pasta(spark, sf), category), category).drop("label").where("key <> 'price_per_base'")


@query("pasta_summary", """
WITH p AS (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS bn, p_type IN ('ECONOMY', 'LARGE') AS m FROM part),
m AS (SELECT * FROM p WHERE m)
SELECT 'classified' AS metric, 'records' AS key, count(*) AS n FROM p
UNION ALL SELECT 'classified', 'match', count(*) FROM m
UNION ALL SELECT 'classified', 'other', count(*) FROM p WHERE NOT m AND p_type <> 'SMALL'
UNION ALL SELECT 'classified', 'no decision', count(*) FROM p WHERE p_type = 'SMALL'
UNION ALL SELECT 'axis price_per_base', 'trusted', count(*) FROM m
UNION ALL SELECT 'axis quantity', 'trusted', count(*) FROM m
UNION ALL SELECT 'axis raw_materials', CASE WHEN p_type = 'LARGE' THEN 'trusted' ELSE 'unknown' END, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'axis ' || a, 'absent', count(*) FROM m, (VALUES ('protein_g'), ('energy_kcal'), ('fiber_g')) t(a) GROUP BY a
UNION ALL SELECT 'claimed', c, count(*) FROM m, (VALUES ('bronze_die'), ('slow_drying')) t(c) WHERE bn <= 10 GROUP BY c
UNION ALL SELECT 'listings', 'with a trusted axis', count(*) FROM m
UNION ALL SELECT 'offers', 'offers', count(*) FROM m
UNION ALL SELECT 'offers', 'folded variants', 0""")
def pasta_summary(spark: SparkSession, sf: str) -> DataFrame:
    category = B.get("dry_pasta")
    return report.summary(B.evaluate(pasta(spark, sf), category), category.axes, category.claims)


def paste(spark: SparkSession, sf: str) -> DataFrame:
    number = views.brand_number()
    bullet = F.when(number <= 5, lit("Die Paste trocknet schnell ab. Wasserlöslich.")) \
        .when(number <= 10, lit("TROCKNET NICHT EIN im Eimer und am Pinsel")) \
        .when(number <= 15, lit("Technologie: Mineralöl, trocknet schnell ab, ohne Mineralöl"))
    return _common(
        views.spread(views.table(spark, sf, "part")),
        title=_cases("p_type", {
            "ECONOMY": "Reifenmontagepaste 1 kg inkl. Pinsel", "PROMO": "Max Grip Carbon Montagepaste 1 kg",
            "STANDARD": "Rundpinsel für Reifenmontagepaste", "SMALL": "Schwammdose transparent 1 kg",
            "MEDIUM": "Montagepaste 1 kg für Schraubengewinde", "LARGE": ""}),
        content=views.shape("content", feature_bullets=F.array_compact(F.array(bullet)), description=F.when(
            F.col("p_type") == "SMALL", lit("Montagegel, das die Montage von Fahrradreifen vereinfacht."))))


@query("paste_cards", """
WITH p AS (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS bn, p_type IN ('ECONOMY', 'SMALL') AS m FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS asin, CASE WHEN m THEN 'tyre_mounting_paste' WHEN p_type <> 'LARGE' THEN 'other' END AS category,
       CASE p_type WHEN 'LARGE' THEN 'unknown' WHEN 'SMALL' THEN 'unverified' ELSE 'trusted' END AS status,
       CASE WHEN m THEN CASE WHEN bn <= 5 THEN 'trusted' WHEN bn BETWEEN 11 AND 15 THEN 'disputed' ELSE 'not_claimed' END END AS dries_out,
       CASE WHEN m THEN CASE WHEN bn BETWEEN 11 AND 15 THEN 'disputed' ELSE 'not_claimed' END END AS mineral_oil_free,
       CASE WHEN m AND bn <= 5 THEN 'dries_out,water_based' ELSE '' END AS answered,
       CASE WHEN m AND bn BETWEEN 11 AND 15 THEN 'mineral_oil_base' ELSE '' END AS adverse FROM p""")
def paste_cards(spark: SparkSession, sf: str) -> DataFrame:
    cards = B.evaluate(paste(spark, sf), B.get("tyre_mounting_paste"))
    at = lambda c, k: F.try_element_at(c, lit(k))
    mine = F.size("axes") > 0
    return cards.select(
        "asin", F.col("category.text").alias("category"), F.col("category.status").alias("status"),
        at("claims", "dries_out")["status"].alias("dries_out"), at("claims", "mineral_oil_free")["status"].alias("mineral_oil_free"),
        F.when(mine, F.array_join("suitability.answered", ",")).otherwise(lit("")).alias("answered"),
        F.when(mine, F.array_join("suitability.adverse", ",")).otherwise(lit("")).alias("adverse"))


def rice(spark: SparkSession, sf: str) -> DataFrame:
    part = views.spread(views.table(spark, sf, "part"))
    origin = _cases("p_type", {"ECONOMY": "Indien", "PROMO": "Deutschland", "STANDARD": "Pakistan"})
    card = views.listing(part.limit(0)).select("reviews").schema["reviews"].dataType["sample"].dataType.elementType
    review = F.struct(*[(lit(5.0) if f.name == "rating" else lit("herrlicher Duft") if f.name == "text"
                         else lit(True) if f.name == "verified" else lit(None)).cast(f.dataType).alias(f.name) for f in card.fields])
    size = F.col("p_size")
    return _common(
        part,
        title=_cases("p_type", {
            "ECONOMY": "Tilda Pure Original Basmati Reis 1 kg", "PROMO": "Tilda Pure Original Basmati Reis 1 kg",
            "STANDARD": "Super Kernel Basmatireis 1 kg", "SMALL": "Basmati Sella Reis 1 kg",
            "MEDIUM": "Langkorn Reis 1 kg", "LARGE": "Basmati Reis Mischung 1 kg"}),
        brand=F.when(F.col("p_type") == "ECONOMY", lit("Tilda")).otherwise(F.col("p_brand")),
        attributes=F.when(origin.isNotNull(), F.create_map(lit("country_of_origin"), origin)),
        content=views.shape("content", feature_bullets=F.when(F.col("p_type") == "SMALL", F.array(lit("Zwei Jahre gereift")))),
        reviews=views.shape("reviews", histogram_percent=F.create_map(lit("five_star"), 100 - size, lit("one_star"), size),
                            sample=F.when(views.brand_number() <= 10, F.array(review))))


@query("rice_cards", """
WITH p AS (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS bn FROM part),
q AS (
  SELECT *, CASE p_type WHEN 'ECONOMY' THEN 0.5 + 0.1 WHEN 'PROMO' THEN 0.5 - 0.05 WHEN 'STANDARD' THEN 0.8 WHEN 'SMALL' THEN 0.5 END::DOUBLE AS a,
         CASE WHEN bn <= 10 THEN 0.78 ELSE 0.5 END::DOUBLE AS t,
         CASE WHEN p_type = 'SMALL' THEN 0.35 ELSE 0.675 END::DOUBLE AS g,
         CASE p_type WHEN 'STANDARD' THEN 3 WHEN 'SMALL' THEN 1 ELSE 2 END / 7::DOUBLE AS o,
         CASE p_type WHEN 'ECONOMY' THEN 0.9 WHEN 'PROMO' THEN 0.7 WHEN 'STANDARD' THEN 0.7 ELSE 0.42 END::DOUBLE AS h,
         greatest(0::DOUBLE, 1 - p_size / 20::DOUBLE) AS c,
         least(1::DOUBLE, (12::DOUBLE - floor(p_retailprice) / 100) / 10::DOUBLE) AS v,
         (CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 1 ELSE 0 END) + (CASE WHEN bn > 10 THEN 1 ELSE 0 END)
           + (CASE WHEN p_type <> 'STANDARD' THEN 1 ELSE 0 END) + (CASE WHEN p_type <> 'SMALL' THEN 1 ELSE 0 END)
           + (CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END) AS gaps,
         p_type NOT IN ('MEDIUM', 'LARGE') AS m FROM p),
r AS (SELECT *, a * 22 + t * 20 + g * 12 + o * 14 + h * 18 + c * 8 + v * 6 AS raw FROM q)
SELECT CAST(p_partkey AS VARCHAR) AS asin, CASE WHEN m THEN 'basmati_rice' ELSE 'other' END AS category,
       CASE WHEN m THEN CASE WHEN p_type = 'SMALL' THEN 'parboiled trusted' ELSE 'white unverified' END END AS grain,
       CASE WHEN m THEN CASE p_type WHEN 'ECONOMY' THEN 'trusted' WHEN 'PROMO' THEN 'unverified' ELSE 'unknown' END END AS external_status,
       CASE WHEN m THEN p_type = 'STANDARD' END AS has_variety, CASE WHEN m AND p_type = 'SMALL' THEN 'disputed' WHEN m THEN 'not_claimed' END AS aged,
       CASE WHEN m THEN bn <= 10 END AS aroma, CASE WHEN m THEN gaps END AS gaps, CASE WHEN m THEN round(raw, 4) END AS raw_score,
       CASE WHEN m THEN round(50 + (raw - 50) * (1 - 0.6::DOUBLE * (gaps / 7::DOUBLE)), 1) END AS total_score FROM r""")
def rice_cards(spark: SparkSession, sf: str) -> DataFrame:
    cards = B.evaluate(rice(spark, sf), B.get("basmati_rice"))
    at = lambda c, k: F.try_element_at(c, lit(k))
    mine = F.col("score").isNotNull()
    from shelfproof.rules import rice as R
    raw = sum((F.col(f"score.parts.{k}") * w for k, w in R.WEIGHTS.items()), lit(0.0))
    return cards.select(
        "asin", F.col("category.text").alias("category"),
        F.when(mine, F.concat_ws(" ", "grain_type.text", "grain_type.status")).alias("grain"),
        F.when(mine, F.col("external_test.status")).alias("external_status"),
        F.when(mine, F.col("cultivar.text").isNotNull()).alias("has_variety"), at("claims", "aged")["status"].alias("aged"),
        F.when(mine, B.found(at("review_signals", "aroma"))).alias("aroma"), F.when(mine, F.size("score.unknown")).alias("gaps"),
        F.round(raw, 4).alias("raw_score"), F.col("score.total").alias("total_score"))


#: A phrase for each signal of the reviews, in their order.
PHRASES = ("herrlicher Duft", "sehr lecker", "wird schön lang", "locker", "seit Jahren", "geruchlos", "Bruchreis", "klebrig",
           "muffig", "ranzig", "Motten", "Steinchen", "letzte Lieferung", "nicht wie beschrieben")


@query("rice_signals", """
WITH s(i, signal) AS (VALUES (0, 'aroma'), (1, 'taste_praise'), (2, 'elongates'), (3, 'fluffy'), (4, 'consistent'), (5, 'no_aroma'),
  (6, 'broken_grain'), (7, 'sticky'), (8, 'odd_smell'), (9, 'rancid'), (10, 'insects'), (11, 'foreign_matter'), (12, 'batch_change'),
  (13, 'not_as_described')),
h AS (SELECT CAST(p_partkey AS VARCHAR) AS asin, signal, p_partkey % 14 = i AND p_partkey % 3 = CASE WHEN i < 5 THEN 0 ELSE 1 END AS told,
        CASE WHEN p_size > 20 AND i < 5 AND (p_partkey + 1) % 14 = i THEN 1 ELSE 0 END AS also FROM part, s)
SELECT asin, signal, CASE WHEN told OR also = 1 THEN 'unverified' ELSE 'unknown' END AS status,
       CASE WHEN told THEN 1 ELSE 0 END + also AS hits FROM h""")
def rice_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Each signal in reviews of many stars, few and none; a large pack has a second, good review with the next phrase."""
    k, part = F.col("p_partkey"), views.spread(views.table(spark, sf, "part"))
    phrases = F.array(*map(lit, PHRASES))
    card = views.listing(part.limit(0)).select("reviews").schema["reviews"].dataType["sample"].dataType.elementType

    def review(text: Column, stars: Column) -> Column:
        values = {"text": text, "rating": stars, "title": lit("Zum Reis")}
        return F.struct(*[values.get(f.name, lit(None)).cast(f.dataType).alias(f.name) for f in card.fields])

    first = review(F.get(phrases, (k % 14).cast("int")), F.when(k % 3 == 0, 5.0).when(k % 3 == 1, 1.0))
    second = review(F.get(phrases, ((k + 1) % 14).cast("int")), lit(4.0))
    listings = _common(part, title=lit("Basmati Reis 1 kg"), reviews=views.shape(
        "reviews", sample=F.when(F.col("p_size") > 20, F.array(first, second)).otherwise(F.array(first))))
    cards = B.evaluate(listings, B.get("basmati_rice"))
    found = F.transform(F.map_entries("review_signals"), lambda e: F.struct(
        e["key"].alias("signal"), e["value"]["status"].alias("status"), F.size(e["value"]["evidence"]).alias("hits")))
    return unfold(cards, found, "s", "asin").select("asin", "s.*")


@query("pasta_drying", """
SELECT CAST(p_partkey AS VARCHAR) AS asin, CASE WHEN p_partkey % 3 < 2 THEN 'unverified' END AS temperature,
       CASE WHEN p_partkey % 3 = 0 THEN 'unverified' END AS hours FROM part""")
def pasta_drying(spark: SparkSession, sf: str) -> DataFrame:
    """How a pasta says it was dried."""
    k, size = F.col("p_partkey"), F.col("p_size")
    listings = _common(
        views.spread(views.table(spark, sf, "part")), title=lit("Spaghetti 1 kg"), breadcrumbs=F.array(lit("Nudeln & Pasta")),
        content=views.shape("content", description=F.when(k % 3 == 0, views.text("Bei ", size + 30, " °C ", size, " Stunden getrocknet"))
                            .when(k % 3 == 1, views.text("getrocknet bei ", size + 30, "°C")).otherwise(lit("an der Luft"))))
    at = lambda key: F.try_element_at("drying", lit(key))["status"]
    return B.evaluate(listings, B.get("dry_pasta")).select(
        "asin", at("drying_temperature").alias("temperature"), at("drying_hours").alias("hours"))


@query("size_labels", """
SELECT CAST(p_partkey AS VARCHAR) AS asin, CASE p_partkey % 4 WHEN 0 THEN p_size || ' g' WHEN 1 THEN '2 x ' || p_size || ' g' WHEN 2 THEN '1,5 kg'
         ELSE '' END AS size_label, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 2 THEN 1500 END::DOUBLE AS grams FROM part""")
def size_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The size a family's matrix gives a listing, and its grams unless it counts packs."""
    k, size = F.col("p_partkey"), F.col("p_size")
    label = F.when(k % 4 == 0, views.text(size, " g")).when(k % 4 == 1, views.text("2 x ", size, " g")).when(k % 4 == 2, lit("1,5 kg"))
    listings = _common(
        views.spread(views.table(spark, sf, "part")), title=lit("Reis"), variation=F.when(label.isNotNull(), views.shape(
            "variation", dimensions=F.array(lit("flavor_name"), lit("size_name")), parent_asin=F.col("p_brand"),
            values_by_asin=F.create_map(k.cast("string"), F.array(lit("pur"), label)))))
    checked = validate(listings, B.get("basmati_rice").profile)
    return checked.select("asin", F.coalesce("size_label", lit("")).alias("size_label"),
                          quantity.size_label_grams(F.col("size_label")).alias("grams"))
