"""Queries over product pages of several shops, written from ``part`` and ``supplier`` rows.

The key of a row decides which shape each block of its page has, by remainders that share no factor where two
blocks meet, so every shape stands beside every other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.functions.values import lit
from shelfproof.operators import blocks, extract
from shelfproof.operators import pages as P
from shelfproof.plans import views
from shelfproof.plans.registry import query
from shelfproof.sources import feeds

SIZE = "p_size"


def asin(column: str = "p_partkey") -> Column:
    return F.concat(lit("B"), F.lpad(F.col(column).cast("string"), 9, "0"))


def by(of: int, **shapes: Column) -> Column:
    """The shape whose number is the key's remainder (``_3``), else nothing."""
    out = None
    for name, shape in shapes.items():
        test = F.col("p_partkey") % of == int(name[1:])
        out = F.when(test, shape) if out is None else out.when(test, shape)
    return out.otherwise(lit(""))


def rows_of(*pairs: tuple) -> Column:
    return views.text(*[x for label, value in pairs for x in ("<tr><th>", label, "</th><td>", value, "</td></tr>")])


def food_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A German product page per part: seven places of nutrients, four of ingredients, five of the total content,
    seven shapes of the gallery, four of the matrix, three of allergens."""
    k, size, name = F.col("p_partkey"), F.col(SIZE), F.col("p_name")
    prose = views.text("Pro 100 g: Fett ", size % 10, ",5 g.")
    fat = views.text(size % 10, ",5 g")
    section = lambda head, body: views.text("<div class='a-section'><h4>", head, "</h4><p>", body, "</p></div>")
    declared = views.text("GRIESS ", size, ", Wasser")
    attributes = views.text(
        by(7, _1=rows_of(("Fett", fat), ("Brennwert", "1500 kJ"), ("Portionsgröße", "80 Gramm"))),
        by(7, _6=rows_of(("Hinweis", prose))),
        by(5, _2=rows_of(("Zutaten", declared)), _3=rows_of(("Servierempfehlung", views.text("Zutaten: ", declared)))),
        by(6, _0=rows_of(("Anzahl der Einheiten", views.text(size, " Gramm"))),
           _1=rows_of(("Artikelgewicht", views.text(size, " g")), ("Stückzahl", "4")),
           _2=rows_of(("Verpackungsgewicht", "2 kg")), _3=rows_of(("Artikelgewicht", views.text(size, " g")))),
        by(3, _1=rows_of(("Allergenhinweis", views.text("Weizen ", size))), _2=rows_of(("Allergenhinweis", "Soja"))),
        rows_of(("Herkunftsland", "Italien")))
    gallery = by(
        7, _0=views.text("A.$.parseJSON('[{\"hiRes\":\"https://img/", k, ".jpg\",\"altText\":\"it\\'s (", size,
                         "\\')\",\"variant\":\"MAIN\"},{\"large\":\"https://img/2.jpg\"},{\"thumb\":\"t.jpg\"}]')"),
        _1=lit("A.$.parseJSON('[\"x\", {\"hiRes\":\"https://img/1.jpg\"}]')"),
        _2=lit("A.$.parseJSON('[{\"main\":{\"u.jpg\":5}}]')"),
        _5=views.text("A.$.parseJSON('[{\"hiRes\":\"https://img/", k, ".jpg\",\"altText\":\"x') y \\\\\" ' )  z\"}]'   )"),
        _6=views.text("[{\"main\":{\"s.jpg\":[10],\"l", k, ".jpg\":[90]}}]"))
    main = by(7, _3=lit("<img id='landingImage' data-a-dynamic-image='{\"a.jpg\":5}'>"),
              _4=views.text("<img id='landingImage' data-a-dynamic-image='{&quot;s.jpg&quot;:[1,1],&quot;l", k,
                            ".jpg&quot;:[9,9]}'>"))
    matrix = by(4, _0=views.text("{\"", asin(), "\":[\"", size, " g\"],\"X\":[\"1 kg\"]}"), _1=lit("\"none\""),
                _2=lit("{}"))
    html = views.text(
        "<html><head><script>P.x({'colorImages': { 'initial': ", F.when(gallery == "", lit("null")).otherwise(gallery),
        "}});</script>", F.when(k % 4 == 3, lit("")).otherwise(views.text(
            "<script>var d = {\"dimensionValuesDisplayData\" : ", matrix, ", \"z\" : [1]};</script>")),
        "</head><body><span id='productTitle'>", name, by(6, _4=views.text(" ", F.lit(6), " x ", size, " g")), "</span>", main,
        "<table id='productDetails_techSpec_section_1'>", attributes, "</table><div id='important-information'>",
        by(5, _1=section("Zutaten", declared)), by(7, _4=section("Nährwerte", prose)), "</div>",
        by(7, _2=views.text("<div id='productDescription'><p>", prose, "</p></div>")),
        by(7, _3=views.text(
            "<div id='aplus'><style>p{}</style><div class='aplus-module premium-module-", size, "'><h3>Kopf ", size, "</h3><p>",
            prose, "</p><img data-src='https://img/a", k, ".jpg' src='grey-pixel.gif' alt=' A  B'><img src='loading-1.jpg'>"
            "<table><tr><th>a</th><td>k", k, "</td></tr><tr><td>b</td><td></td></tr></table></div></div>")),
        by(7, _5=views.text("<div id='feature-bullets'><ul><li><span class='a-list-item'>", prose, "</span></li></ul></div>")),
        by(7, _0=views.text("<div id='nic-eu-nutrition-facts'><table>", rows_of(("Energie", "1500 kJ"), ("Fett", fat)),
                            "</table></div>")),
        by(5, _0=views.text("<div id='nic-ingredients-content'>Zutaten: ", declared, "</div>")),
        by(3, _0=views.text("<p id='nic-allergens-contains'>Enthält ", size, "</p>"),
           _2=lit("<div id='nic-allergens'>Soja</div><div id='nic-allergens-may'>Ei</div>")), "</body></html>")
    return views.spread(views.table(spark, sf, "part")).select(
        asin().alias("asin"), lit("run").alias("run_id"), html.alias("html"), lit("2026-01-02T03:04:05+00:00").alias("fetched_at"))


def _food(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(food_pages(spark, sf), "amazon.de")


PART_SQL = "WITH p AS (SELECT *, p_partkey AS k, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin FROM part)"


@query("page_food", PART_SQL + """
SELECT asin, CASE k % 7 WHEN 0 THEN 'nutrition_card' WHEN 1 THEN 'attributes' WHEN 2 THEN 'text:description' WHEN 3 THEN 'text:aplus'
         WHEN 4 THEN 'text:important_information' WHEN 5 THEN 'text:feature_bullets' ELSE 'text:raw_tables' END AS nutrition_source,
       CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '80 Gramm' ELSE '100 g' END AS basis, p_size % 10 + 0.5::DOUBLE AS fat,
       CASE WHEN k % 7 < 2 THEN 358.5::DOUBLE END AS kcal,
       CASE WHEN k % 5 <> 4 THEN 'GRIESS ' || p_size || ', Wasser' END AS ingredients,
       CASE k % 5 WHEN 0 THEN 'nutrition_card' WHEN 1 THEN 'important_information' WHEN 2 THEN 'attributes'
         WHEN 3 THEN 'raw_tables:Servierempfehlung' END AS ingredients_source,
       CASE k % 3 WHEN 0 THEN 'Enthält ' || p_size WHEN 1 THEN 'Weizen ' || p_size ELSE 'Soja|Ei' END AS allergens,
       CASE k % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 4 WHEN 2 THEN 2000 WHEN 3 THEN p_size WHEN 4 THEN p_size * 6 END::DOUBLE AS total,
       CASE k % 6 WHEN 0 THEN 'unit_count' WHEN 1 THEN 'item_weight_x_count' WHEN 2 THEN 'package_weight' WHEN 3 THEN 'item_weight'
         WHEN 4 THEN 'title_multipack' END AS total_source FROM p""")
def page_food(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of nutrients, ingredients, allergens and total content."""
    per = lambda key: F.try_element_at("food.nutrition.per_100g", lit(key))
    return _food(spark, sf).select(
        "asin", F.col("food.nutrition.source").alias("nutrition_source"), F.col("food.nutrition.basis_text").alias("basis"),
        per("fat_g").alias("fat"), per("energy_kcal").alias("kcal"), F.col("food.ingredients.text").alias("ingredients"),
        F.col("food.ingredients.source").alias("ingredients_source"), F.array_join("food.allergens", "|").alias("allergens"),
        F.col("package.total_quantity_base").alias("total"), F.col("package.total_quantity_source").alias("total_source"))


@query("page_media", PART_SQL + """
SELECT asin, CASE k % 7 WHEN 0 THEN 3 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 1 END AS images,
       CASE k % 7 WHEN 0 THEN 'https://img/' || k || '.jpg' WHEN 5 THEN 'https://img/' || k || '.jpg' WHEN 4 THEN 'l' || k || '.jpg'
         WHEN 6 THEN 'l' || k || '.jpg' END AS image,
       CASE k % 7 WHEN 0 THEN 'it''s (' || p_size || ''')' WHEN 5 THEN 'x'') y " '') z' WHEN 4 THEN '' WHEN 6 THEN '' END AS alt,
       CASE WHEN k % 7 = 4 THEN 'dynamic_image' WHEN k % 7 IN (0, 5, 6) THEN 'color_images' END AS image_source,
       CASE WHEN k % 4 = 0 THEN p_size || ' g' END AS size_name,
       CASE WHEN k % 7 = 3 THEN 'premium-module-' || p_size END AS modules, CASE WHEN k % 7 = 3 THEN 'Kopf ' || p_size END AS headings,
       CASE WHEN k % 7 = 3 THEN 'Kopf ' || p_size || ' Pro 100 g: Fett ' || p_size % 10 || ',5 g. a k' || k || ' b' END AS aplus_text,
       CASE WHEN k % 7 = 3 THEN 'https://img/a' || k || '.jpg A B' END AS aplus_image,
       CASE WHEN k % 7 = 3 THEN 'k' || k END AS aplus_cell FROM p""")
def page_media(spark: SparkSession, sf: str) -> DataFrame:
    """Galleries in every shape, the main image in their place, the matrix, and enhanced content."""
    first, aplus = F.get("media.images", lit(0)), F.col("content.aplus")
    image, table = F.get(aplus["images"], lit(0)), F.get(aplus["tables"], lit(0))
    return _food(spark, sf).select(
        "asin", F.col("media.image_count").alias("images"), F.col("media.primary_image").alias("image"), first["alt"].alias("alt"),
        F.col("media.image_source").alias("image_source"),
        F.get(F.try_element_at("variation.values_by_asin", F.col("asin")), lit(0)).alias("size_name"),
        F.array_join(aplus["module_types"], "|").alias("modules"), F.array_join(aplus["headings"], "|").alias("headings"),
        aplus["text"].alias("aplus_text"), F.concat(image["url"], lit(" "), image["alt"]).alias("aplus_image"),
        F.get(F.get(table, lit(0)), lit(1)).alias("aplus_cell"))


@query("page_block_status", PART_SQL + """,
b(block) AS (VALUES ('raw_tables'), ('important_information'), ('feature_bullets'), ('description'), ('aplus'), ('ingredients'),
  ('nutrition'), ('media'), ('variation'), ('rating'), ('reviews'), ('package'), ('brand'), ('price'), ('unit_price'),
  ('breadcrumbs'), ('allergens')),
e AS (SELECT asin, block, k, CASE
        WHEN block = 'media' AND k % 7 = 1 THEN 'a gallery record is not an object'
        WHEN block = 'media' AND k % 7 = 2 THEN 'a gallery record''s sizes are not lists'
        WHEN block = 'media' AND k % 7 = 3 THEN 'an image''s sizes are not lists'
        WHEN block = 'variation' AND k % 4 = 1 THEN 'dimensionValuesDisplayData does not have its shape' END AS error FROM p, b)
SELECT asin, block, error, CASE WHEN error IS NOT NULL THEN 'error'
   WHEN block IN ('rating', 'reviews', 'brand', 'price', 'unit_price', 'breadcrumbs') OR (block = 'variation' AND k % 4 > 1)
     OR (block = 'important_information' AND k % 5 <> 1 AND k % 7 <> 4) OR (block = 'feature_bullets' AND k % 7 <> 5)
     OR (block = 'description' AND k % 7 <> 2) OR (block = 'aplus' AND k % 7 <> 3) OR (block = 'ingredients' AND k % 5 = 4)
     THEN 'absent' ELSE 'present' END AS state FROM e""")
def page_block_status(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks present, absent or failed; one that fails leaves the others of its page as they are."""
    return extract.block_status(_food(spark, sf))


# --- pages of many elements ---------------------------------------------------------------------------

@query("page_padded", """
SELECT s_suppkey, 'T ' || s_suppkey AS title, round(s_acctbal, 2) AS price, 'Italien' AS origin, 2 AS bullets,
       1000 + s_suppkey % 50 AS rows, 10 + 2 * (1000 + s_suppkey % 50) * 3 + 5 AS elements FROM supplier""")
def page_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with thousands of elements: a long table and as many boxes around few blocks."""
    n = (F.lit(1000) + F.col("s_suppkey") % 50).cast("int")
    html = views.text(
        "<html><body>", F.repeat(lit("<div class='a-section'><span class='a-offscreen'>9,99</span><i></i></div>"), n),
        "<span id='productTitle'>T ", F.col("s_suppkey"), "</span><div id='corePrice_desktop'><span class='a-offscreen'>",
        F.translate(F.format_number("s_acctbal", 2), ",.", ".,"), " €</span></div>",
        "<table id='productDetails_techSpec_section_1'><tr><th>Herkunftsland</th><td>Italien</td></tr>",
        F.repeat(lit("<tr><td>Marke</td><td>x</td></tr>"), n), "</table>",
        "<div id='feature-bullets'><ul><li><span class='a-list-item'>eins</span></li><li><span class='a-list-item'>zwei</span></li>"
        "</ul></div></body></html>")
    pages = views.spread(views.table(spark, sf, "supplier")).select("s_suppkey", html.alias("html"))
    whole = extract.extract(
        pages.select(F.col("s_suppkey").cast("string").alias("asin"), "html"), "amazon.de",
        lambda page: {"rows": F.size(page.places("tr")) - 1, "elements": F.size("els")})
    return whole.select(F.col("asin").cast("bigint").alias("s_suppkey"), "title", F.col("price.amount").alias("price"),
                        F.try_element_at("attributes", lit("country_of_origin")).alias("origin"),
                        F.size("content.feature_bullets").alias("bullets"), "rows", "elements")


# --- several shops, and what the crawl knew ---------------------------------------------------------------

def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per part, its run by the key's remainder of 5: German and American shops, one without a name, an unknown one,
    and runs without a manifest."""
    run = F.col("p_partkey") % 5
    english = run.isin(1, 3)
    dollars = F.format_number("p_retailprice", 2)
    price = F.when(run == 1, F.concat(lit("$"), dollars)).when(run == 3, dollars).otherwise(
        F.concat(F.translate(dollars, ",.", ".,"), lit(" €")))
    html = views.text(
        "<html><body><span id='productTitle'>", F.col("p_name"), "</span><div id='corePrice_desktop'><span class='a-offscreen'>",
        price, "</span></div><table id='productDetails_techSpec_section_1'>",
        F.when(english, rows_of(("Country of Origin", "Italy"), ("Item Weight", views.text(F.col(SIZE), " g")),
                                ("Hint", views.text("Total fat ", F.col(SIZE) % 10, ".5 g per 100 g"))))
        .otherwise(rows_of(("Herkunftsland", "Italien"), ("Artikelgewicht", views.text(F.col(SIZE), " g")),
                           ("Hinweis", views.text("Fett ", F.col(SIZE) % 10, ",5 g pro 100 g")))),
        "</table><div data-hook='review' id='R'><span data-hook='review-body'>", F.when(english, lit("Good. Read more"))
        .otherwise(lit("Gut. Mehr erfahren")), "</span><span data-hook='review-date'>", F.when(
            english, lit("Reviewed in the United States on March 6, 2026")).otherwise(lit("Bewertet in Italien am 6. März 2026")),
        "</span></div></body></html>")
    return views.spread(views.table(spark, sf, "part")).select(
        asin().alias("asin"), views.text("run", run).alias("run_id"), html.alias("html"),
        lit("2026-01-02T03:04:05+00:00").alias("fetched_at"))


def shop_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of the runs, as far as they have one."""
    run = F.col("run")
    market = F.when(run == 0, lit("https://www.amazon.de/")).when(run == 1, lit("amazon.com")).when(run == 3, lit("shop.example"))
    return views.table(spark, sf, "part").select((F.col("p_partkey") % 5).alias("run")).where("run < 4").distinct().select(
        views.text("run", run).alias("run_id"), market.alias("marketplace"), F.struct(
            F.when(run < 2, lit("de-DE")).alias("accept_language"), F.when(run < 2, views.text("l", run)).alias("language")).alias("locale"))


def crawl_feed(spark: SparkSession, sf: str) -> str:
    """A feed of JSON lines, written to the shared folder: missing, null and repeated keys, records without an id."""
    say = lambda *more: F.concat(lit("{\"asin\":\""), asin(), lit("\""), *[views.text(m) for m in more], lit("}"))
    asked = views.text(",\"search_query\":\"query ", F.col("p_type"), "\"")
    shape = F.col("p_partkey") % 7
    lines = F.when(shape == 1, F.array(say(asked, ",\"run_id\":\"feed\""))).when(
        shape == 2, F.array(say(",\"search_query\":null,\"locale\":null"))).when(shape == 3, F.array(say())).when(
        shape == 4, F.array(say(asked, ",\"search_page\":1"), say(",\"locale\":\"xx\""))).when(
        shape == 5, F.array(lit("{\"asin\":\"\",\"search_query\":\"lost\"}"), lit("{\"asin\":null,\"search_query\":\"lost\"}"))).when(
        shape == 6, F.array(say(asked, ",\"fetched_at\":\"2025-05-05T00:00:00+00:00\",\"search_page\":2,\"search_position\":17")))
    folder = views.scratch(spark, "crawl-feed")
    views.table(spark, sf, "part").select(F.explode(lines).alias("value")).write.option("compression", "gzip").text(folder)
    return folder


@query("page_reextract", PART_SQL + """,
s AS (SELECT *, k % 5 AS r, k % 7 AS f, CASE k % 5 WHEN 0 THEN 'https://www.amazon.de/' WHEN 1 THEN 'amazon.com' WHEN 3 THEN 'shop.example'
        ELSE '' END AS marketplace FROM p)
SELECT asin, marketplace, 'https://' || marketplace || '/dp/' || asin AS product_url,
       CASE WHEN f IN (1, 6) THEN 'query ' || p_type END AS search_query, CASE WHEN f = 6 THEN 2 END AS search_page,
       CASE WHEN f = 1 THEN 'feed' ELSE 'run' || r END AS run_id,
       CASE WHEN f = 2 THEN NULL WHEN f = 4 THEN 'xx' WHEN r < 2 THEN 'l' || r ELSE '' END AS locale,
       CASE WHEN r < 2 THEN 'de-DE' ELSE '' END AS accept_language,
       CASE WHEN f = 6 THEN '2025-05-05T00:00:00+00:00' ELSE '2026-01-02T03:04:05+00:00' END AS fetched_at,
       p_retailprice AS price, CASE r WHEN 1 THEN 'USD' WHEN 3 THEN '' ELSE 'EUR' END AS currency,
       CASE WHEN r IN (1, 3) THEN 'Italy' ELSE 'Italien' END AS origin, p_size::DOUBLE AS weight, p_size % 10 + 0.5::DOUBLE AS fat,
       CASE WHEN r IN (1, 3) THEN 'Good.' ELSE 'Gut.' END AS review, '2026-03-06' AS review_date, r IN (1, 3) AS review_home FROM s""")
def page_reextract(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of several shops read again by their own rules in one scan; the feed's keys win where its record has them."""
    feed = feeds.read_feeds(spark, [crawl_feed(spark, sf)], present=True)
    card = F.get("reviews.sample", lit(0))
    return extract.reextract(shop_pages(spark, sf), shop_runs(spark, sf), "amazon.de", feed).select(
        "asin", "marketplace", "product_url", "search_query", "search_page", "run_id", "locale", "accept_language", "fetched_at",
        F.col("price.amount").alias("price"), F.col("price.currency").alias("currency"),
        F.try_element_at("attributes", lit("country_of_origin")).alias("origin"), F.col("package.item_weight_base").alias("weight"),
        F.try_element_at("food.nutrition.per_100g", lit("fat_g")).alias("fat"), card["text"].alias("review"),
        card["date"].alias("review_date"), card["home_marketplace"].alias("review_home"))


# --- prices and other short blocks, collapsible sections -----------------------------------------------------

@query("page_prices", PART_SQL + """
SELECT asin, CASE k % 6 WHEN 0 THEN 3 + (k % 90 + 10) / 100::DOUBLE WHEN 2 THEN p_size + 0.5 WHEN 4 THEN 4.2 WHEN 5 THEN 1000 + p_size + 0.5 END::DOUBLE AS amount,
       CASE WHEN k % 6 = 3 THEN NULL WHEN k % 6 = 4 THEN 'GBP' ELSE 'EUR' END AS currency,
       CASE k % 6 WHEN 0 THEN '3,' || (k % 90 + 10) || ' €' WHEN 1 THEN '5,63€ - 26,15€' WHEN 2 THEN p_size || ',50 €' WHEN 4 THEN '£4.20'
         WHEN 5 THEN '1.0' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ',50 €' END AS text,
       CASE WHEN k % 6 = 1 THEN 5.63::DOUBLE END AS low, CASE WHEN k % 6 = 1 THEN 26.15::DOUBLE END AS high,
       CASE WHEN k % 2 = 0 THEN 'Auf Lager.' ELSE 'Nicht verfügbar' END AS availability,
       CASE k % 3 WHEN 0 THEN 'Shop ' || k WHEN 1 THEN 'Laden ' || k ELSE 'Selbst' END AS seller,
       CASE k % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Filed' ELSE '' END AS brand, '12,3' || p_size % 10 || ' € / kg' AS unit_text,
       12.3::DOUBLE + (p_size % 10) / 100::DOUBLE AS unit_amount FROM p""")
def page_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Prices with a savings clause, as a range, in parts, in another place, in another currency, escaped twice."""
    k, size = F.col("p_partkey"), F.col(SIZE)
    box = lambda name, inner: views.text("<div id='", name, "'>", inner, "</div>")
    label = "<span class='a-offscreen'>"
    price = by(
        6, _0=views.text("<span id='apex-pricetopay-accessibility-label'>3,", k % 90 + 10, " € mit 5 Prozent Einsparungen</span>"),
        _1=box("corePrice_desktop", lit(f"<span class='a-price-range'>{label}5,63€</span> - {label}26,15€</span></span>")),
        _2=box("apex_desktop", views.text(label, "EUR</span><span class='a-price-whole'>", size, "</span><span class='a-price-fraction'>50"
                                          "</span><span class='a-price-symbol'>€</span>")),
        _3=lit(f"<div class='carousel'>{label}1,00 €</span></div>"),
        _4=F.concat(box("corePrice_feature_div", lit("<b>no price</b>")), box("newBuyBoxPrice", lit(f"{label}£4.20</span>"))),
        _5=box("corePriceDisplay_desktop_feature_div", views.text(
            label, "1.0", F.lpad(size.cast("string"), 2, "0"), ",50&amp;nbsp;&amp;euro;</span>")))
    html = views.text(
        "<html><body><span id='title'>t</span>", price, "<span class='pricePerUnit'>12,3", size % 10, " &#8364; / kg</span>",
        by(2, _0=box("availability", lit("<span> Auf Lager. </span>")), _1=box("availability", lit("Nicht verfügbar"))),
        by(3, _0=views.text("<a id='sellerProfileTriggerId'>Shop ", k, "</a>"), _1=box("merchant-info", views.text("von <a>Laden ", k, "</a>")),
           _2=box("merchant-info", lit("Selbst"))),
        by(3, _0=views.text("<a id='bylineInfo'>Marke: ", F.col("p_brand"), "</a>"),
           _1=views.text("<a id='bylineInfo'>Besuche den X-Store</a><table id='productDetails_techSpec_section_1'>",
                         rows_of(("Marke", "Filed")), "</table>")), "</body></html>")
    pages = views.spread(views.table(spark, sf, "part")).select(asin().alias("asin"), html.alias("html"))
    return extract.extract(pages, "amazon.de").select(
        "asin", F.round("price.amount", 2).alias("amount"), F.col("price.currency").alias("currency"), F.col("price.text").alias("text"),
        F.get("price.range", lit(0)).alias("low"), F.get("price.range", lit(1)).alias("high"), "availability", "seller", "brand",
        F.col("unit_price.text").alias("unit_text"), F.col("unit_price.amount").alias("unit_amount"))


@query("page_expanders", """
SELECT s_suppkey, i AS place, CASE i WHEN 1 THEN 'Kopf ' || s_suppkey WHEN 2 THEN '' ELSE 'Nur Kopf' END AS heading,
       CASE i WHEN 1 THEN 'Text ' || s_name || ' und mehr' WHEN 2 THEN 'Ohne Kopf' ELSE '' END AS text
FROM supplier, (VALUES (1), (2), (3)) t(i)""")
def page_expanders(spark: SparkSession, sf: str) -> DataFrame:
    """Collapsible sections: with a heading, without one, with nothing else, and an empty one that is left out."""
    part = lambda head, body: views.text(
        "<div class='a-expander-container'>", head, "<div>", body, "</div></div>")
    head = lambda text: views.text("<a class='a-expander-prompt'> ", text, " </a>")
    body = lambda text: views.text("<p class='a-expander-content'>", text, "</p>")
    html = views.text("<div class='a-expander-container'><a class='a-expander-prompt'>elsewhere</a></div><div id='details'>", part(
        head(views.text("Kopf ", F.col("s_suppkey"))), body(views.text("Text ", F.col("s_name"), "<style>x</style> und <b>mehr</b>"))),
        part("", body("Ohne Kopf")), part("", ""), part(head("Nur Kopf"), ""), "</div>")
    pages = views.spread(views.table(spark, sf, "supplier")).select("s_suppkey", html.alias("html"))
    page = P.Page()
    found = blocks.expanders(page, "#details")
    return P.tokenise(pages, page).select("s_suppkey", F.posexplode(found).alias("at", "s")).select(
        "s_suppkey", (F.col("at") + 1).alias("place"), "s.heading", "s.text")


@query("page_accepted", PART_SQL + """
SELECT asin, CASE WHEN k % 4 > 1 THEN p_name END AS title, CASE k % 4 WHEN 0 THEN 'challenge_text' WHEN 1 THEN 'parse_failed' END AS refused FROM p""")
def page_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Only pages that hold a product are extracted; bot checks and pages without a title are named."""
    k = F.col("p_partkey")
    html = F.when(k % 4 == 0, lit("<p>Enter the characters you see below</p>")).when(k % 4 == 1, lit("<p>no title node</p>")).otherwise(
        views.text("<span id='productTitle'>", F.col("p_name"), "</span>"))
    pages = views.spread(views.table(spark, sf, "part")).select(asin().alias("asin"), html.alias("html"))
    content, rest = extract.accepted(pages)
    named = rest.select("asin", F.coalesce("challenge", F.when(F.col("parse_failed"), lit("parse_failed")), "page_error").alias("refused"))
    return extract.extract(content, "amazon.de").select("asin", "title").unionByName(named, allowMissingColumns=True)
