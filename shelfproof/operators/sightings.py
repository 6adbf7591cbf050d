"""Search result pages and the log of what was seen on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.functions import labels as LB
from shelfproof.functions.text import clean, decode_entities, group, number
from shelfproof.functions.values import let, lit, nth, unfold
from shelfproof.operators import pages as P
from shelfproof.rules import locale as L


def _markers(page: P.Page, tile: Column) -> Column:
    labelled = F.size(page.places(".*sponsored-label*", within=tile)) > 0
    ads = F.exists(page.pick("a", within=tile), lambda e: F.coalesce(P.attr(e, "href").contains("/sspa/click"), lit(False)))
    return LB.sponsored_markers(P.attr(tile, "class"), labelled, ads)


def sightings(pages: DataFrame, host: str) -> DataFrame:
    """Search pages (query, search_page, html, ...) to one row per result tile.

    ``position`` counts every tile in page order, ``grid_position`` only the
    tiles of the result grid; both are array positions, so no sort is needed.
    A tile without an id of its own takes it from its headline's link.
    """
    page = P.Page()
    _, _, decimal, _ = L.MARKETPLACES.get(host, L.FALLBACK)
    grid = page.places("div [data-component-type=s-search-result]")
    tiles = F.filter(page.pick("div .s-result-item"), lambda e: P.attr(e, "data-asin").isNotNull())

    def one(tile: Column, i: Column, ranks: Column) -> Column:
        own_id = group(P.attr(tile, "data-asin"), "^(" + L.ASIN_BARE + ")$", 1)
        heads = page.places("h2", within=tile)
        links = F.filter(page.pick("a", within=tile), lambda e: F.exists(
            heads, lambda h: (h > e["ord"]) & (h <= e["last"])))
        href = P.attr(nth(links, 0), "href")
        asin = F.coalesce(own_id, group(F.try_url_decode(href), L.ASIN_LINK, 1))
        title = page.first_text(("[data-cy=title-recipe]", "h2", "span"), ("h2", "span"),
                             ("h2", "a", "span"), within=tile)
        price = decode_entities(page.first_text((".a-price", ".a-offscreen"), within=tile))
        rank = F.array_position(ranks, tile["ord"])
        markers = _markers(page, tile)
        return F.struct(
            (i + 1).cast("int").alias("position"), F.when(rank > 0, rank.cast("int")).alias("grid_position"),
            (rank > 0).alias("in_result_grid"), asin.alias("asin"), (F.size(markers) > 0).alias("sponsored"),
            markers.alias("sponsored_markers"), title.alias("result_title"), price.alias("result_price_text"),
            number(price, decimal).alias("result_price_amount"),
            F.concat(lit(f"https://{host}/dp/"), asin).alias("product_url"))

    found = let(grid, lambda ranks: F.transform(tiles, lambda t, i: one(t, i, ranks)))
    tokens = P.tokenise(pages, page)
    keep = [c for c in tokens.columns if c not in P.READ]
    return unfold(tokens, F.filter(found, lambda s: s["asin"].isNotNull()), "s", *keep).select(*keep, "s.*")


def last_page(pages: DataFrame) -> DataFrame:
    """Highest numbered page the pagination offers, 1 when it offers none."""
    page = P.Page()
    labels = F.flatten(F.transform(page.pick(".*s-pagination-item*"), page.lines_of))
    numbers = F.transform(F.filter(labels, lambda t: t.rlike(r"^\d+$")), lambda t: t.try_cast("int"))
    tokens = P.tokenise(pages, page)
    keep = [c for c in tokens.columns if c not in P.READ]
    return tokens.select(*keep, F.coalesce(F.array_max(numbers), lit(1)).alias("last_page"))


def normalise(raw: DataFrame) -> DataFrame:
    """Raw log lines to typed sightings: text cleaned, price read in the row's own locale."""
    profile = LB.profile(F.col("marketplace"))
    text = decode_entities(clean(F.col("result_price_text")))
    out = raw.withColumn("result_title", clean(F.col("result_title"))).withColumn("result_price_text", text)
    return out.withColumns({
        "result_price_amount": number(F.col("result_price_text"), profile["decimal"]),
        "currency": LB.currency(F.col("result_price_text"), profile["currency"]),
        "sponsored": F.coalesce(F.size("sponsored_markers") > 0, lit(False)),
        "in_result_grid": F.col("grid_position").isNotNull()})


def stats(log: DataFrame, by=("query",), asin: str = "asin") -> DataFrame:
    """Per group: sightings, distinct products, repeats, sponsored share.

    Repeats are counted from one row per (group, product), so no task holds all
    the sightings of a group.
    """
    per_product = log.groupBy(*by, asin).agg(
        F.count(lit(1)).alias("n"), F.count_if("sponsored").alias("s"))
    return per_product.groupBy(*by).agg(
        F.sum("n").alias("occurrences"), F.count(lit(1)).alias("products"),
        F.sum(F.col("n") - 1).alias("repeats"), F.sum("s").alias("sponsored"),
        F.round(F.sum("s") / F.sum("n"), 6).alias("sponsored_share"))


def shared_products(log: DataFrame, query: str = "query", asin: str = "asin") -> DataFrame:
    """Products that more than one query finds."""
    return (log.groupBy(asin, query).agg(F.count(lit(1)).alias("n"))
            .groupBy(asin).agg(F.count(lit(1)).alias("queries"), F.sum("n").alias("occurrences"))
            .where("queries > 1"))


def first_sightings(log: DataFrame, keys=("run_id", "asin"), order=("seen_at",)) -> DataFrame:
    """The first sighting of each product in a run; the log itself keeps every one."""
    return (log.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where("_r = 1").drop("_r"))
