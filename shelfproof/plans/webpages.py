"""Queries over pages: the driver's own pages, and product and search pages written from ``part`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.functions.values import lit
from shelfproof.operators import coverage, extract, merge, sightings
from shelfproof.operators import pages as P
from shelfproof.plans import views
from shelfproof.plans.registry import query

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace({t}, '[\s\x{a0}]+', ' ', 'g'), ' ([,.;:!?%)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'))"""
# As in HTML, these references count without their semicolon, too.
UNESCAPE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({t}, '&lt;?', '<', 'g'), '&#39;', ''''), '&#39([^0-9]|$)', '''\1', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""


def _tokens(spark: SparkSession, sf: str, page: P.Page) -> DataFrame:
    return P.tokenise(views.spread(views.table(spark, sf, "pages")).select("page_id", "html"), page)


@query("page_titles", "SELECT page_id, " + CLEAN.replace("{t}", UNESCAPE.replace(
    "{t}", "regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')")) + " AS heading, " + CLEAN.replace("{t}", UNESCAPE.replace(
        "{t}", "regexp_extract(html, '<title>(.*?)</title>', 1, 's')")) + " AS title FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    page = P.Page()
    heading, title = page.first_text(("h1",)), page.first_text(("title",))
    return _tokens(spark, sf, page).select("page_id", heading.alias("heading"), title.alias("title"))


@query("page_bullets", """
WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1, 's')) AS t,
                   generate_subscripts(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1, 's'), 1) AS i FROM pages),
c AS (SELECT page_id, i, """ + CLEAN.replace("{t}", UNESCAPE.replace("{t}", "regexp_replace(t, '<[^>]*>', ' ', 'g')")) + """ AS text FROM li),
d AS (SELECT page_id, text, min(i) AS i FROM c WHERE text <> '' GROUP BY page_id, text)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position, text FROM d""")
def page_bullets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct list items in page order; positions are array positions."""
    page = P.Page()
    items = page.bullets("li")
    return _tokens(spark, sf, page).select("page_id", F.posexplode_outer(items).alias("p", "text")) \
        .where(F.col("text").isNotNull()).select("page_id", (F.col("p") + 1).alias("position"), "text")


@query("page_links", """
SELECT page_id, len(regexp_extract_all(html, '<a\\s')) AS links, len(regexp_extract_all(html, '<a\\s[^>]*href="/')) AS internal
FROM pages""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    page = P.Page()
    links = page.pick("a")
    return _tokens(spark, sf, page).select("page_id", F.size(links).alias("links"), F.size(F.filter(
        links, lambda e: F.coalesce(P.attr(e, "href").startswith("/"), lit(False)))).alias("internal"))


@query("page_text")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    page = P.Page()
    text = page.first_text(("body",))
    return _tokens(spark, sf, page).select("page_id", text.alias("text"), F.size("els").alias("elements"), "page_error")


@query("page_gate", """
SELECT page_id, CASE WHEN length(html) < 120000 AND (contains(lower(html), 'enter the characters you see below')
         OR contains(lower(html), 'api-services-support@amazon.com')) THEN 'challenge_text' END AS challenge,
       NOT regexp_matches(html, 'id="(productTitle|title)"') AS parse_failed FROM pages""")
def page_gate(spark: SparkSession, sf: str) -> DataFrame:
    return P.gate(views.spread(views.table(spark, sf, "pages")).select("page_id", "html")).select("page_id", "challenge", "parse_failed")


@query("page_redact", """
SELECT page_id, md5(html || '<script>ue_sid = ''000-0000000-0000000''; ue_id=''XXXXXXXXXXXXXXXXXXXX'';</script><a href="?s=000-0000000-0000000&r=XXXXXXXXXXXXXXXXXXXX">'
  || '</a><div data-rid="00000000-0000-0000-0000-000000000000">{"ipAddress":"0.0.0.0","arid":"00000000-0000-0000-0000-000000000000"} 000-0000000-0000000</div>') AS digest
FROM pages""")
def page_redact(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with identifiers written into it must come out as with the fixed values."""
    sid = F.concat(lit("S"), F.lpad(F.col("page_id").cast("string"), 12, "0"))
    rid = F.concat(lit("R"), F.lpad(F.col("page_id").cast("string"), 19, "0"))
    html = views.text(
        F.col("html"), "<script>ue_sid = '", sid, "'; ue_id='", rid, "';</script><a href=\"?s=", sid, "&r=", rid,
        "\"></a><div data-rid=\"", rid, "\">{\"ipAddress\":\"10.1.2.3\",\"rid\" : \"", sid, "\"} 123-4567890-1234567</div>")
    pages = views.spread(views.table(spark, sf, "pages")).select("page_id", html.alias("html"))
    return P.redact_pages(pages).select("page_id", F.md5("html").alias("digest"))


# --- product pages written from part rows ---------------------------------------------------

def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One product page per part; its type decides which blocks are there."""
    size, kind = F.col("p_size"), F.col("p_type")
    euro = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    id_ = F.concat(lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    price = (F.when(kind == "MEDIUM", views.text(
        "<div id='corePrice_desktop'><span class='a-price-range'><span class='a-offscreen'>5,63&nbsp;€</span> - "
        "<span class='a-offscreen'>", euro, "&nbsp;€</span></span></div>"))
        .when(kind == "LARGE", lit("<div class='carousel'><span class='a-price'><span class='a-offscreen'>1,00 €</span></span></div>"))
        .when(kind == "SMALL", views.text(
            "<div id='apex_desktop'><span class='a-offscreen'>EUR</span><span class='a-price-whole'>",
            F.floor("p_retailprice"), "</span><span class='a-price-fraction'>50</span><span class='a-price-symbol'>€</span></div>"))
        .otherwise(views.text("<div id='corePrice_desktop'><span class='a-offscreen'>", euro, "&nbsp;€</span></div>")))
    html = views.text(
        "<!DOCTYPE html><html><head><title>x</title><link rel='canonical' href='https://www.amazon.de/x/dp/", id_, "'>",
        "<script>var d = {\"parentAsin\":\"", F.regexp_replace("p_brand", "#", "_"), "\",\"dimensions\":[\"size_name\"],"
        "\"dimensionValuesDisplayData\":{\"", id_, "\":[\"", size, " g\"],\"X\":[\"1 kg\"]},\"z\":[1]};"
        "P.register({'colorImages': { 'initial': A.$.parseJSON('[{\"hiRes\":\"https://img/", F.col("p_partkey"),
        ".jpg\",\"altText\":\"it\\'s\"},{\"large\":\"https://img/2.jpg\"}]')}});</script><style>p{}</style></head><body>",
        "<div id='wayfinding-breadcrumbs_feature_div'><ul><li><a> Lebensmittel</a><li><a>", kind, "</a></ul></div>",
        "<span id='productTitle'> ", F.col("p_name"), "‎  (", size, " g ) </span>",
        "<a id='bylineInfo' href='/s'>Besuche den ", F.col("p_brand"), "-Store</a>", price,
        "<span class='pricePerUnit'>(", euro, "&amp;nbsp;&amp;euro; / 100 g)</span>",
        "<i id='acrPopover' title='4,", size % 10, " von 5 Sternen'></i><span id='acrCustomerReviewText'>1.", F.lpad(
            size.cast("string"), 3, "0"), " Bewertungen</span>",
        "<div id='productOverview_feature_div'><table class='a-normal a-spacing-micro'><tr><td>Artikelgewicht:<td>", size,
        " Gramm</tr><tr><td>Stückzahl</td><td>4</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table></div>",
        "<div id='detailBullets_feature_div'><ul><li><span class='a-list-item'><span>Herkunftsland ‏ : ‎</span> "
        "<span>Italien</span></span></li><li>Artikelgewicht : 9 kg</li></ul></div>",
        "<div id='feature-bullets'><ul><li><span class='a-list-item'>", F.col("p_name"), "</span></li><li><span class='a-list-item'>",
        F.col("p_name"), "</span></li><li><span class='a-list-item'>", kind, "<script>x()</script></span></li></ul></div>",
        F.when(kind == "ECONOMY", lit(
            "<div id='important-information'><div class='a-section'><div class='a-section'><h4>Zutaten</h4>"
            "<p>Zutaten: <b>HARTWEIZENGRIEß</b>, Wasser.</p></div></div></div>")).otherwise(lit("")),
        "<div id='productDescription'><p>Pro 100 g: Brennwert 1500 kJ, Fett ", size % 10, ",5 g, Eiweiß 12 g</p></div>",
        "<div id='histogramTable'><a aria-label='", size, " Prozent der Bewertungen haben 5 Sterne'></a>"
        "<a aria-label='", 100 - size, " Prozent der Bewertungen haben 1 Sterne'></a></div>",
        "<div data-hook='review' id='R", F.col("p_partkey"), "'><i data-hook='review-star-rating'><span>4,0 von 5 Sternen</span></i>"
        "<a data-hook='review-title'><span>4,0 von 5 Sternen</span><span>Gut</span></a>"
        "<span data-hook='review-date'>Bewertet in Italien am 6. März 2026</span><a data-hook='format-strip'>Größe: ", size,
        " g</a><span data-hook='review-body'><span>Schmeckt ", F.col("p_name"), " Mehr erfahren</span></span></div></body></html>")
    return views.spread(views.table(spark, sf, "part")).select(
        id_.alias("asin"), lit("run").alias("run_id"), html.alias("html"), lit("2026-01-02T03:04:05+00:00").alias("fetched_at"))


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(product_pages(spark, sf), "amazon.de")


PRODUCT_SQL = """
WITH p AS (SELECT *, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin FROM part)
"""


@query("page_extract", PRODUCT_SQL + """
SELECT asin, 'https://www.amazon.de/x/dp/' || asin AS canonical_url, p_name || ' (' || p_size || ' g)' AS title, p_brand AS brand,
       CASE p_type WHEN 'MEDIUM' THEN NULL WHEN 'LARGE' THEN NULL WHEN 'SMALL' THEN floor(p_retailprice) + 0.5::DOUBLE
            ELSE p_retailprice END AS price, CASE WHEN p_type = 'MEDIUM' THEN 5.63::DOUBLE END AS price_low,
       p_retailprice AS unit_price, '100 g' AS unit, 4 + (p_size % 10) / 10::DOUBLE AS rating, 1000 + p_size AS ratings,
       p_size * 4::DOUBLE AS total, 'item_weight_x_count' AS total_source, 2 AS bullets, p_type AS last_crumb,
       'Italien' AS origin, 'table' AS weight_source, 'https://img/' || p_partkey || '.jpg' AS image, 2 AS images,
       replace(p_brand, '#', '_') AS family, 2 AS members, p_size AS five_star,
       CASE WHEN p_type = 'ECONOMY' THEN 'HARTWEIZENGRIEß, Wasser.' END AS ingredients,
       (p_size % 10) + 0.5::DOUBLE AS fat, 358.5::DOUBLE AS kcal, 'text:description' AS nutrition_source,
       'Schmeckt ' || p_name AS review, '2026-03-06' AS review_date, false AS review_home, p_size || ' g' AS review_variant
FROM p""")
def page_extract(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c, k: F.try_element_at(c, lit(k))
    card = F.get("reviews.sample", lit(0))
    return _listings(spark, sf).select(
        "asin", "canonical_url", "title", "brand", F.col("price.amount").alias("price"), F.get("price.range", lit(0)).alias("price_low"),
        F.col("unit_price.amount").alias("unit_price"), F.col("unit_price.unit").alias("unit"), F.col("rating.value").alias("rating"),
        F.col("rating.count").alias("ratings"), F.col("package.total_quantity_base").alias("total"),
        F.col("package.total_quantity_source").alias("total_source"), F.size("content.feature_bullets").alias("bullets"),
        F.element_at("breadcrumbs", -1).alias("last_crumb"), at("attributes", "country_of_origin").alias("origin"),
        at("attribute_sources", "Artikelgewicht").alias("weight_source"), F.col("media.primary_image").alias("image"),
        F.col("media.image_count").alias("images"), F.col("variation.parent_asin").alias("family"),
        F.size("variation.values_by_asin").alias("members"), at(F.col("reviews.histogram_percent"), "five_star").alias("five_star"),
        F.col("food.ingredients.text").alias("ingredients"), at(F.col("food.nutrition.per_100g"), "fat_g").alias("fat"),
        at(F.col("food.nutrition.per_100g"), "energy_kcal").alias("kcal"), F.col("food.nutrition.source").alias("nutrition_source"),
        card["text"].alias("review"), card["date"].alias("review_date"), card["home_marketplace"].alias("review_home"),
        card["variant"].alias("review_variant"))


@query("page_coverage", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (p_type NOT IN ('MEDIUM', 'LARGE')) AS priced, count(*) FILTER (p_type = 'ECONOMY') AS food
           FROM part)
SELECT f.field, CASE f.kind WHEN 0 THEN 0 WHEN 1 THEN n WHEN 2 THEN priced ELSE food END AS filled, n AS records
FROM c, (VALUES ('title', 1), ('brand', 1), ('price', 2), ('unit_price', 1), ('rating', 1), ('rating_count', 1), ('feature_bullets', 1),
  ('description', 1), ('important_information', 3), ('aplus', 0), ('ingredients', 3), ('allergens', 0), ('nutrition', 1),
  ('nutrition_protein', 1), ('raw_tables', 1), ('country_of_origin', 1), ('total_quantity', 1), ('images', 1), ('breadcrumbs', 1),
  ('variation', 1), ('review_histogram', 1), ('review_sample', 1)) f(field, kind)""")
def page_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage(_listings(spark, sf))


@query("page_source_counts", """
SELECT 'nutrition' AS kind, 'text:description' AS name, count(*) AS n FROM part
UNION ALL SELECT 'ingredients', 'important_information', count(*) FROM part WHERE p_type = 'ECONOMY'""")
def page_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.source_counts(_listings(spark, sf))


@query("page_run_report", """
SELECT count(*) AS pages, count(*) AS records, 0 AS block_errors, 0 AS failed, count(*) FILTER (p_size > 25) AS unseen FROM part""")
def page_run_report(spark: SparkSession, sf: str) -> DataFrame:
    pages = product_pages(spark, sf)
    feed = views.table(spark, sf, "part").where("p_size <= 25").select(
        F.concat(lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("asin"))
    return coverage.run_report(_listings(spark, sf), merge.unseen(pages.select("asin"), feed))


# --- search pages -------------------------------------------------------------------------------

def search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One search page per part: an ad tile, a grid tile, the same product sponsored, a tile known by its link only."""
    one = F.concat(lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    two = F.concat(lit("C"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    euro = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    tile = "<div class='s-result-item {c}' data-asin='"
    html = views.text(
        "<html><body>", tile.replace("{c}", "ad"), "'><h2><span>Ad</span></h2></div>",
        "<div class='s-result-item' data-component-type='s-search-result' data-asin='", one, "'><h2><span> ", F.col("p_name"),
        " </span></h2><span class='a-price'><span class='a-offscreen'>", euro, "&amp;nbsp;€</span></span></div>",
        tile.replace("{c}", "AdHolder"), one, "'><h2><span>", F.col("p_name"), "</span></h2><span class='puis-sponsored-label-text'>x</span></div>",
        "<div class='s-result-item' data-component-type='s-search-result' data-asin=''><a href='/sspa/click?u=%2Fx%2Fdp%2F", two,
        "%2F'><h2><span>", F.col("p_type"), "</span></h2></a></div>",
        "<span class='s-pagination-item'>Zurück</span><span class='s-pagination-item'>", F.col("p_size"),
        "</span><a class='s-pagination-item'>2</a></body></html>")
    return views.spread(views.table(spark, sf, "part")).select("p_partkey", F.col("p_brand").alias("query"), html.alias("html"))


@query("search_sightings", """
WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS k FROM part)
SELECT p_partkey, p_brand AS query, 2 AS position, 1 AS grid_position, 'B' || k AS asin, false AS sponsored, '' AS markers, p_name AS result_title,
       p_retailprice AS result_price_amount FROM p
UNION ALL SELECT p_partkey, p_brand, 3, NULL, 'B' || k, true, 'ad_holder,sponsored_label', p_name, NULL FROM p
UNION ALL SELECT p_partkey, p_brand, 4, 2, 'C' || k, true, 'sspa_link', p_type, NULL FROM p""")
def search_sightings(spark: SparkSession, sf: str) -> DataFrame:
    return sightings.sightings(search_pages(spark, sf), "amazon.de").select(
        "p_partkey", "query", "position", "grid_position", "asin", "sponsored", F.array_join("sponsored_markers", ",").alias("markers"),
        "result_title", "result_price_amount")


@query("search_last_page", "SELECT p_partkey, greatest(p_size, 2) AS last_page FROM part")
def search_last_page(spark: SparkSession, sf: str) -> DataFrame:
    return sightings.last_page(search_pages(spark, sf)).select("p_partkey", "last_page")
