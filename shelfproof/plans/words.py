"""Queries over texts: claims, polarity, labels, numbers, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.functions import labels as LB
from shelfproof.functions import spans
from shelfproof.functions import text as TX
from shelfproof.functions.values import expr, lit, unfold
from shelfproof.operators import coverage, normalise, search
from shelfproof.plans import views
from shelfproof.plans.registry import query

# ASCII patterns without word boundaries, so they mean the same in both engines.
CLAIMS = [("licence", "licen[cs]e|copyright"), ("contact", r"[a-z0-9._]+@[a-z0-9-]+\.[a-z]+"),
          ("number", "[0-9]{3,}"), ("linking", "tion")]

FIELDS_SQL = """
WITH fields AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
claims(claim, p) AS (VALUES ('licence', 'licen[cs]e|copyright'), ('contact', '[a-z0-9._]+@[a-z0-9-]+\\.[a-z]+'),
                            ('number', '[0-9]{3,}'), ('linking', 'tion')),
hits AS (SELECT doc_id, ord, claim, row_number() OVER (PARTITION BY doc_id, claim ORDER BY ord) AS rank
         FROM fields, claims WHERE regexp_matches(text, p, 'i'))
"""


@query("claim_search", FIELDS_SQL + """
SELECT doc_id, ord, CASE WHEN ord = 0 THEN 'title' ELSE 'content.feature_bullets[' || (ord - 1) || ']' END AS field, claim, rank
FROM hits WHERE rank <= 3""")
def claim_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.claim_hits(views.text_fields(spark, sf), CLAIMS, "doc_id").drop("quote")


@query("claim_quotes")
def claim_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return search.claim_hits(views.text_fields(spark, sf), CLAIMS, "doc_id", limit=1).select("doc_id", "claim", "quote")


@query("claim_counts", FIELDS_SQL + """
SELECT claim, count(DISTINCT doc_id) AS documents, count(*) AS fields FROM hits GROUP BY claim""")
def claim_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Fields and documents per claim; counted per document first, so a common claim is not one big group."""
    hit = F.array_compact(F.array(*[F.when(TX.matches(F.col("text"), "(?i)" + p), lit(k)) for k, p in CLAIMS]))
    per_doc = (unfold(views.text_fields(spark, sf), hit, "claim", "doc_id")
               .groupBy("doc_id", "claim").agg(F.count(lit(1)).alias("n")))
    return per_doc.groupBy("claim").agg(F.count(lit(1)).alias("documents"), F.sum("n").alias("fields"))


@query("claim_affirmative", r"""
SELECT doc_id, regexp_matches(text, 'the|que|der', 'i') AS mentioned,
       regexp_matches(regexp_replace(regexp_replace(text,
           '(^|[^\pL\pN_])(non|nicht|nie|kaum|kein|keine|keinen|keinem|keiner|keines|ohne|no|not|without|free\s+of|free\s+from|frei\s+von)[\s\-]*(the|que|der)',
           '\1|', 'gi'), '(the|que|der)[\s\-]*(frei|free)($|[^\pL\pN_])', '|', 'gi'), 'the|que|der', 'i') AS affirmed
FROM documents""")
def claim_affirmative(spark: SparkSession, sf: str) -> DataFrame:
    pattern = "(?iU)the|que|der"
    text = F.col("text")
    return views.spread(views.table(spark, sf, "documents")).select(
        "doc_id", TX.matches(text, pattern).alias("mentioned"),
        expr(spans.first_span("text", pattern, affirmative=True)).isNotNull().alias("affirmed"))


@query("field_coverage", """
WITH c AS (SELECT count(*) AS records, count(*) FILTER (text <> '') AS text, count(*) FILTER (lang <> '') AS lang,
                  count(*) FILTER (source <> '') AS source, count(*) FILTER (n_chars > 0) AS n_chars,
                  count(*) FILTER (contains(text, chr(10))) AS bullets FROM documents)
SELECT f.field, CASE f.field WHEN 'text' THEN text WHEN 'lang' THEN lang WHEN 'source' THEN source
       WHEN 'n_chars' THEN n_chars ELSE bullets END AS filled, records
FROM c, (VALUES ('text'), ('lang'), ('source'), ('n_chars'), ('bullets')) f(field)""")
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c) != "", lit(False))
    return coverage.coverage(views.spread(views.table(spark, sf, "documents")), {
        "text": some("text"), "lang": some("lang"), "source": some("source"),
        "n_chars": F.coalesce(F.col("n_chars") > 0, lit(False)), "bullets": F.col("text").contains("\n")})


@query("clean_text", r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text,
             '[\x{200b}\x{200c}\x{200d}\x{200e}\x{200f}\x{2060}\x{feff}]', '', 'g'),
             '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}\x{1c}-\x{1f}]+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, ' ([,.;:!?%)\]])', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\pL\pM\pN_]) (-\pL)', '\1\2', 'g'), '([\pL\pM\pN_]) (-\pL)', '\1\2', 'g') AS t FROM b)
SELECT doc_id, md5(trim(regexp_replace(t, '([(\[]) ', '\1', 'g'))) AS digest,
       length(trim(regexp_replace(t, '([(\[]) ', '\1', 'g'))) AS chars FROM c""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    t = views.spread(views.table(spark, sf, "documents")).select("doc_id", TX.clean(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@query("decoded_entities", """
SELECT p_partkey, p_name || ' ' || p_size || ' € & "' || p_brand || '" ' || chr(228) AS decoded FROM part""")
def decoded_entities(spark: SparkSession, sf: str) -> DataFrame:
    escaped = views.text(F.col("p_name"), "&nbsp;", F.col("p_size"), "&#160;&euro; &amp; &quot;", F.col("p_brand"),
                         "&#34; &#xE4;")
    return views.spread(views.table(spark, sf, "part")).select("p_partkey", TX.decode_entities(escaped).alias("decoded"))


@query("locale_number", """
SELECT c_custkey, round(c_acctbal, 2) AS german, round(c_acctbal, 2) AS english,
       CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(c_acctbal AS BIGINT) END AS whole,
       CAST(c_custkey AS DOUBLE) / 1000 AS german_thousand, CAST(c_custkey AS DOUBLE) AS english_thousand FROM customer""")
def locale_number(spark: SparkSession, sf: str) -> DataFrame:
    """Balances written in two locales and read back; ``1,500`` is 1.5 in one and 1500 in the other."""
    english = F.format_number("c_acctbal", 2)
    german = F.translate(english, ",.", ".,")
    grouped = F.concat(F.floor(F.col("c_custkey") / 1000).cast("string"), lit(","),
                       F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return views.spread(views.table(spark, sf, "customer")).select(
        "c_custkey", TX.number(F.concat(german, lit(" €")), ",").alias("german"),
        TX.number(F.concat(lit("$"), english), ".").alias("english"),
        TX.whole_number(german, ",").alias("whole"),
        TX.number(grouped, ",").alias("german_thousand"), TX.number(grouped, ".").alias("english_thousand"))


@query("quantity_parse", """
SELECT p_partkey, p_size * 1.5::DOUBLE AS kg_amount, p_size * 1500::DOUBLE AS kg_base, p_size * 250::DOUBLE AS ml_base,
       p_size * 28.3495::DOUBLE AS oz_base, 'kg' AS kg_unit, 'ml' AS ml_unit FROM part""")
def quantity_parse(spark: SparkSession, sf: str) -> DataFrame:
    part = views.spread(views.table(spark, sf, "part"))
    kg = TX.quantity(views.text(F.col("p_size"), " x 1,5 kg"))
    ml = TX.quantity(views.text(F.col("p_size"), "× 250 Milliliter"))
    oz = TX.quantity(views.text(F.col("p_size"), " ounces"), ".")
    return part.select("p_partkey", kg["amount"].alias("kg_amount"), kg["base"].alias("kg_base"), ml["base"].alias("ml_base"),
                       oz["base"].alias("oz_base"), kg["unit"].alias("kg_unit"), ml["unit"].alias("ml_unit"))


LABELS = {"ECONOMY": " Artikelgewicht: ", "PROMO": "STÜCKZAHL", "STANDARD": "Paketgröße - Name", "SMALL": "Zutaten",
          "MEDIUM": " Anzahl\u00a0der Einheiten:", "LARGE": "Unbekannt"}


def _by_type(values: dict[str, str]):
    out = None
    for kind, v in values.items():
        out = F.when(F.col("p_type") == kind, lit(v)) if out is None else out.when(F.col("p_type") == kind, lit(v))
    return out


@query("attribute_labels", """
SELECT p_partkey AS asin, CASE p_type WHEN 'ECONOMY' THEN 'item_weight' WHEN 'PROMO' THEN 'item_count'
         WHEN 'STANDARD' THEN 'package_size' WHEN 'SMALL' THEN 'ingredients' WHEN 'MEDIUM' THEN 'unit_count' END AS canonical_key,
       p_size::DOUBLE AS amount, 'g' AS unit, p_size::DOUBLE AS base, p_type = 'SMALL' AS ingredient_heading FROM part""")
def attribute_labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.spread(views.table(spark, sf, "part")).select(
        F.col("p_partkey").alias("asin"), _by_type(LABELS).alias("label"), views.text(F.col("p_size"), " Gramm").alias("value"))
    return normalise.attributes(raw).select("asin", "canonical_key", "amount", "unit", "base", "ingredient_heading")


@query("first_label_per_key", """
SELECT asin, canonical_key, value FROM (
  SELECT l_orderkey AS asin, l_returnflag AS canonical_key, l_quantity AS value, row_number() OVER (
    PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def first_label_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("asin"), F.col("l_returnflag").alias("canonical_key"),
        F.col("l_quantity").alias("value"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"))
    return normalise.first_per_key(rows).drop("ord")


NUTRIENT_LABELS = {"ECONOMY": "— davon gesättigte Fettsäuren (in g)", "PROMO": "Brennwert", "STANDARD": "Eiweiß:",
                   "SMALL": "Fettgehalt", "MEDIUM": "davon Zucker", "LARGE": "Vitamin C"}


@query("nutrient_labels", """
SELECT p_partkey AS asin, CASE p_type WHEN 'ECONOMY' THEN 'saturated_fat_g' WHEN 'PROMO' THEN 'energy_kj'
         WHEN 'STANDARD' THEN 'protein_g' WHEN 'SMALL' THEN 'fat_g' WHEN 'MEDIUM' THEN 'sugars_g' END AS key,
       p_size + 0.5::DOUBLE AS amount, CASE WHEN p_type = 'PROMO' THEN 'kcal' ELSE 'g' END AS unit,
       CASE p_type WHEN 'ECONOMY' THEN 'saturated_fat_g' WHEN 'PROMO' THEN 'energy_kcal'
         WHEN 'STANDARD' THEN 'protein_g' WHEN 'SMALL' THEN 'fat_g' WHEN 'MEDIUM' THEN 'sugars_g' END AS stored_as FROM part""")
def nutrient_labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.spread(views.table(spark, sf, "part")).select(
        F.col("p_partkey").alias("asin"), _by_type(NUTRIENT_LABELS).alias("label"),
        views.text(F.col("p_size"), ",5 ", F.when(F.col("p_type") == "PROMO", lit("kcal")).otherwise(lit("g"))).alias("value_text"))
    return normalise.nutrients(raw).drop("label", "value_text")


@query("review_cards", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Deutschland' WHEN 'O' THEN 'Italien' ELSE 'Frankreich' END AS country,
       CAST(o_orderdate AS DATE) AS date, o_orderstatus = 'F' AS home_marketplace,
       o_orderpriority IN ('1-URGENT', '2-HIGH') AS verified,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '5-LOW' THEN NULL
            ELSE o_custkey END AS helpful_votes,
       CAST(left(o_orderpriority, 1) AS INT) AS stars, CAST(o_custkey % 101 AS INT) AS percent,
       'Gut ' || o_orderpriority AS text FROM orders""")
def review_cards(spark: SparkSession, sf: str) -> DataFrame:
    month = F.element_at(F.array(*[lit(m) for m in (
        "Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November",
        "Dezember")]), F.month("o_orderdate"))
    country = F.when(F.col("o_orderstatus") == "F", lit("Deutschland")).when(
        F.col("o_orderstatus") == "O", lit("Italien")).otherwise(lit("Frankreich"))
    level = F.col("o_orderpriority")
    raw = views.spread(views.table(spark, sf, "orders")).select(
        "o_orderkey",
        views.text("Bewertet in ", country, " am ", F.dayofmonth("o_orderdate"), ". ", month, " ", F.year("o_orderdate")).alias("dateline"),
        F.when(level.isin("1-URGENT", "2-HIGH"), lit("Verifizierter Kauf")).otherwise(lit("")).alias("badge"),
        F.when(level == "1-URGENT", lit("Eine Person fand diese Informationen hilfreich"))
         .when(level != "5-LOW", F.concat(F.translate(F.format_number("o_custkey", 0), ",", "."),
                                          lit(" Personen fanden diese Informationen hilfreich"))).alias("votes_text"),
        views.text((F.col("o_custkey") % 101), " Prozent der Bewertungen haben ", F.substring(level, 1, 1), " Sterne").alias("bar_label"),
        views.text("Gut ", level, " Mehr erfahren").alias("body"))
    return normalise.reviews(raw).select("o_orderkey", "country", "date", "home_marketplace", "verified", "helpful_votes",
                                         "stars", "percent", "text")


@query("word_stems", """
SELECT doc_id, regexp_matches(text, '(^|[^\\pL\\pM\\pN_])' || CASE WHEN lang = 'de' THEN 'ver' ELSE 'the($|[^\\pL\\pM\\pN_])' END, 'i') AS found
FROM documents""")
def word_stems(spark: SparkSession, sf: str) -> DataFrame:
    """A stem may open a compound in German and must be a whole word elsewhere; the pattern is a column."""
    german = F.col("lang") == "de"
    stem = F.when(german, lit("ver")).otherwise(lit("the"))
    return views.spread(views.table(spark, sf, "documents")).select("doc_id", F.coalesce(F.rlike(
        "text", TX.word_pattern(stem, F.when(german, lit("de")).otherwise(lit("en")))), lit(False)).alias("found"))


@query("run_locales", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'de' WHEN 'MACHINERY' THEN 'en' WHEN 'FURNITURE' THEN 'de'
         WHEN 'HOUSEHOLD' THEN 'fr' END AS language,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'matches' WHEN 'MACHINERY' THEN 'matches' WHEN 'FURNITURE' THEN 'conflict'
         WHEN 'HOUSEHOLD' THEN 'conflict' ELSE 'unset' END AS status,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'amazon.com' ELSE 'amazon.de' END AS host FROM customer""")
def run_locales(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    header = F.when(segment == "BUILDING", lit("de-DE,de;q=0.9")).when(segment == "MACHINERY", lit("en-US,en")) \
        .when(segment == "FURNITURE", lit("de")).when(segment == "HOUSEHOLD", lit("fr;q=1")).otherwise(lit(" "))
    host = F.when(segment.isin("MACHINERY", "FURNITURE"), lit("https://www.amazon.com/s?k=x")).otherwise(lit("WWW.Amazon.de/"))
    check = LB.locale_status(header, LB.profile(host)["language"])
    return views.spread(views.table(spark, sf, "customer")).select(
        "c_custkey", check["language"].alias("language"), check["status"].alias("status"), LB.host_key(host).alias("host"))


@query("product_ids", """
SELECT p_partkey, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS first_id, 2 AS ids FROM part""")
def product_ids(spark: SparkSession, sf: str) -> DataFrame:
    one = F.concat(lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    listed = views.text("https://www.amazon.de/dp/", one, "?x=1; ", one, " , B0", F.lpad(F.col("p_size").cast("string"), 8, "X"))
    ids = LB.product_ids(listed)
    return views.spread(views.table(spark, sf, "part")).select("p_partkey", F.get(ids, lit(0)).alias("first_id"), F.size(ids).alias("ids"))


@query("brand_bylines", "SELECT p_partkey, p_brand AS brand FROM part")
def brand_bylines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("p_size") <= 15, views.text("Besuche den ", F.col("p_brand"), "-Store")) \
        .when(F.col("p_size") <= 30, views.text("Marke: ", F.col("p_brand"))) \
        .otherwise(views.text("Besuchen Sie den ", F.col("p_brand"), " Store"))
    return views.spread(views.table(spark, sf, "part")).select("p_partkey", LB.byline(line, "de").alias("brand"))
