"""Product pages to listings, with today's rules, and which blocks were there."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfproof.functions import labels as LB
from shelfproof.functions.text import IU, clean, decode_entities, group, lookup, matches, number, quantity
from shelfproof.functions.values import cases, col, filled, let, lit, nth, unfold
from shelfproof.operators import blocks as K
from shelfproof.operators import merge
from shelfproof.operators import pages as P
from shelfproof.rules import locale as L
from shelfproof.schema import CRAWL_FIELDS, LISTING

SCHEMA_VERSION = 6

# Price containers in order, prefixes of ingredient texts, the
# prose that confirms a per-100 basis, and the conversion of energy.
PRICE_CONTAINERS = ("#corePriceDisplay_desktop_feature_div", "#corePrice_feature_div",
                    "#corePrice_desktop", "#apex_desktop", "#price_inside_buybox", "#newBuyBoxPrice")
INGREDIENT_PREFIX = r"(?i)^\s*(zutaten|bestandteile|ingredients|inhaltsstoffe)\s*:"
INGREDIENT_STRIP = r"(?i)^\s*(zutaten|bestandteile|ingredients|inhaltsstoffe)\s*:?\s*"
NUTRIENT_VALUE = r"(?i)\d[\d.,]*\s*(kcal|kj|mg|g|gramm|gram)\b"
BASIS = r"(?i)(?:pro|per|/)\s*100\s*(?:g|ml|gramm)|100\s*g\b"
KJ_PER_KCAL = 4.184


def plain_host(host: str) -> str:
    return host.strip().lower().rstrip("/").split("://")[-1].removeprefix("www.")


class _Profile:
    """The rules of one marketplace, or of each page's own from the column ``_shop`` (``labels.profile``)."""

    def __init__(self, host: str | None) -> None:
        if host is None:
            shop = F.col("_shop")
            self.language, self.currency, self.decimal, self.home = (
                shop[n] for n in ("language", "currency", "decimal", "home"))
        else:
            self.language, self.currency, self.decimal, self.home = L.MARKETPLACES.get(plain_host(host), L.FALLBACK)


# --- price and rating -----------------------------------------------------------

def _priced(text: Column, low: Column | None = None, high: Column | None = None) -> Column:
    none = lit(None).cast("string")
    return F.struct(text.alias("text"), (none if low is None else low).alias("low"),
                    (none if high is None else high).alias("high"))


def _container_price(page: P.Page, box: Column, p: _Profile) -> Column:
    """What one price container states: a range, a decimal label, rebuilt parts, any label."""
    def ends(node: Column) -> Column:
        return F.filter(F.transform(page.texts_of(page.pick(".a-offscreen", within=node)), decode_entities),
                        LB.has_decimal)

    ranges = F.filter(F.transform(page.pick(".a-price-range", within=box), ends), lambda e: F.size(e) >= 2)
    span = nth(ranges, 0)
    parts = F.struct(
        decode_entities(page.first_text((".a-offscreen",), within=box)).alias("label"),
        page.first_text(("span .a-price-whole",), within=box).alias("whole"),
        page.first_text(("span .a-price-fraction",), within=box).alias("fraction"),
        page.first_text(("span .a-price-symbol",), within=box).alias("symbol"))
    return F.when(span.isNotNull(), _priced(
        F.concat(nth(span, 0), lit(" - "), F.element_at(span, -1)), nth(span, 0), F.element_at(span, -1))
    ).otherwise(let(parts, lambda x: cases(
        (LB.has_decimal(x["label"]), _priced(x["label"])),
        ((x["whole"] != "") & (x["fraction"] != ""), _priced(F.trim(F.concat(
            x["whole"], F.when(x["whole"].rlike(r"[.,]$"), lit("")).otherwise(col(p.decimal)), x["fraction"],
            lit(" "), x["symbol"])))),
        (x["label"] != "", _priced(x["label"])),
        otherwise=lit(None))))


def price(page: P.Page, p: _Profile) -> Column:
    """The page's own price; a range has no amount, and no other place is read."""
    label = decode_entities(page.first_text(("#apex-pricetopay-accessibility-label",)))
    boxes = page.elements(F.flatten(F.array(*[page.places(c) for c in PRICE_CONTAINERS])))
    stated = nth(F.array_compact(F.transform(boxes, lambda b: _container_price(page, b, p))), 0)

    def build(x: Column) -> Column:
        text = x["text"]
        span = F.when(x["low"].isNotNull(), F.array(number(x["low"], p.decimal), number(x["high"], p.decimal)))
        return F.when(F.coalesce(text != "", lit(False)), F.struct(
            F.when(span.isNull(), number(text, p.decimal)).alias("amount"),
            LB.currency(text, p.currency).alias("currency"),
            F.when(span.isNull(), LB.price_head(text)).otherwise(text).alias("text"),
            span.alias("range")))

    return let(label, lambda t: let(F.when(LB.has_decimal(t), _priced(t)).otherwise(
        F.coalesce(stated, _priced(t))), build))


def unit_price(page: P.Page, p: _Profile) -> Column:
    text = decode_entities(page.first_text(
        (".apex-priceperunit-accessibility-label",), ("span .pricePerUnit",),
        ("#corePriceDisplay_desktop_feature_div", ".a-size-mini .a-color-base")))
    return let(text, lambda t: F.when(t != "", F.struct(
        number(t, p.decimal).alias("amount"),
        F.coalesce(F.lower(clean(group(t, IU + r"(?:/|pro|per)\s*(100\s*\w+|\w+)\s*\)?$", 1))), lit("")).alias("unit"),
        t.alias("text"))))


def rating(page: P.Page, p: _Profile) -> Column:
    popover = P.attr(page.first("#acrPopover"), "title")
    text = F.coalesce(filled(clean(popover)), page.first_text(
        ("#averageCustomerReviews", ".a-icon-alt"), ("#acrPopover", ".a-size-small")))
    counted = page.first_text(("#acrCustomerReviewText",), ("div [data-hook=total-review-count]",))
    return let(F.struct(text.alias("t"), counted.alias("c")), lambda x: F.when(
        (x["t"] != "") | (x["c"] != ""), F.struct(
            number(x["t"], p.decimal).alias("value"), number(x["c"], p.decimal).try_cast("bigint").alias("count"),
            x["t"].alias("text"), x["c"].alias("count_text"))))


# --- package --------------------------------------------------------------------

def package(attributes: Column, title: Column, p: _Profile) -> Column:
    """Weights and counts, and the total content by the most reliable row there is.

    A weight filed under a count label is a weight: the value's shape decides.
    """
    def raw(key: str) -> Column:
        return filled(F.try_element_at(attributes, lit(key)))

    read = F.struct(*[quantity(raw(k), p.decimal).alias(k) for k in
                      ("item_weight", "package_weight", "unit_count", "volume", "item_count")],
                    quantity(F.concat(group(title, r"(?iU)(\d+)\s*[x×]\s*(\d[\d.,]*\s*(?:g|kg|ml|l)\b)", 1), lit(" x "),
                                      group(title, r"(?iU)(\d+)\s*[x×]\s*(\d[\d.,]*\s*(?:g|kg|ml|l)\b)", 2)),
                             p.decimal).alias("title"))

    def build(q: Column) -> Column:
        refiled = q["unit_count"].isNull() & q["item_count"].isNotNull()
        unit_count = F.coalesce(q["unit_count"], q["item_count"])
        count = F.when(q["item_count"].isNull(), number(raw("item_count"), p.decimal))
        count = F.when(count >= 1, count.try_cast("int"))
        item, whole = q["item_weight"], q["package_weight"]

        def total(amount: Column, source: str, unit: Column) -> Column:
            return F.struct(F.round(amount, 2).alias("amount"), lit(source).alias("source"), unit.alias("unit"))

        chosen = cases(
            (unit_count["base"] != 0, total(unit_count["base"], "unit_count", unit_count["unit"])),
            ((item["base"] != 0) & (count > 0), total(item["base"] * count, "item_weight_x_count", item["unit"])),
            (whole["base"] != 0, total(whole["base"], "package_weight", whole["unit"])),
            (item["base"] != 0, total(item["base"], "item_weight", item["unit"])),
            (q["title"].isNotNull(), total(q["title"]["base"], "title_multipack", q["title"]["unit"])),
            otherwise=lit(None))

        def measure(name: str, v: Column, text: Column) -> list[Column]:
            return [text.alias(f"{name}_text"), F.round(v["amount"], 4).alias(f"{name}_amount"),
                    v["unit"].alias(f"{name}_unit"), F.round(v["base"], 4).alias(f"{name}_base")]

        return let(chosen, lambda t: F.struct(
            *measure("item_weight", item, raw("item_weight")),
            *measure("package_weight", whole, raw("package_weight")),
            *measure("unit_count", unit_count, F.when(refiled, raw("item_count")).otherwise(raw("unit_count"))),
            *measure("volume", q["volume"], raw("volume")), count.alias("item_count"),
            F.coalesce(raw("package_size"), lit("")).alias("size_name"),
            F.coalesce(raw("dimensions"), lit("")).alias("dimensions"),
            t["amount"].alias("total_quantity_base"),
            F.when(t.isNotNull(), F.when(t["unit"].isin(*L.VOLUME_UNITS), lit("ml")).otherwise(lit("g")))
             .alias("total_quantity_unit"),
            t["source"].alias("total_quantity_source")))

    return let(read, build)


# --- food -----------------------------------------------------------------------

def ingredients(page: P.Page, important: Column, attributes: Column, pairs: Column, p: _Profile) -> Column:
    """Declaration text with the block it came from, by the order of trust."""
    card = page.first_text(("#nic-ingredients-content",))
    section = nth(F.filter(important, lambda s: LB.is_ingredient_heading(s["heading"], p.language)), 0)
    filed = filled(F.try_element_at(attributes, lit("ingredients")))
    prefixed = nth(F.filter(pairs, lambda e: matches(e["value"], INGREDIENT_PREFIX)), 0)

    def found(text: Column, source: Column) -> Column:
        return F.struct(F.trim(F.regexp_replace(text, INGREDIENT_STRIP, "")).alias("text"), source.alias("source"))

    return cases(
        (card != "", found(card, lit("nutrition_card"))),
        (section.isNotNull(), found(section["text"], lit("important_information"))),
        (filed.isNotNull(), found(filed, lit("attributes"))),
        (prefixed.isNotNull(), found(prefixed["value"], F.concat(lit("raw_tables:"), prefixed["label"]))),
        otherwise=lit(None))


def allergens(page: P.Page, attributes: Column) -> Column:
    """Texts of the boxes whose id starts with the allergens' name, then the declared ones."""
    boxes = page.pick("#nic-allergens*")
    declared = filled(F.try_element_at(attributes, lit("allergen_info")))
    return F.array_distinct(F.concat(page.texts_of(boxes), F.array_compact(F.array(declared))))


def _target(key: Column, unit: Column) -> Column:
    """Energy rows in kcal are stored under the kcal key."""
    return F.when((key == "energy_kj") & (unit == "kcal"), lit("energy_kcal")).otherwise(key)


def _row(label: Column, text: Column, amount: Column, unit: Column, key: Column, confirmed=None) -> Column:
    return F.struct(key.alias("key"), label.alias("label"), amount.cast("double").alias("amount"),
                    unit.alias("unit"), text.alias("value_text"),
                    (lit(None).cast("boolean") if confirmed is None else confirmed).alias("basis_confirmed"))


def _finish(rows: Column, basis: Column, source: Column) -> Column:
    """Store each nutrient once, first row wins; kcal is derived only where it is missing."""
    stored = F.filter(F.transform(rows, lambda r: F.struct(
        _target(r["key"], r["unit"]).alias("key"), r["amount"].alias("value"))),
        lambda e: e["key"].isNotNull() & e["value"].isNotNull())

    def build(s: Column) -> Column:
        names = F.transform(s, lambda e: e["key"])
        first = F.filter(s, lambda e, i: F.array_position(names, e["key"]) == i + 1)
        kj = nth(F.filter(s, lambda e: e["key"] == "energy_kj"), 0)["value"]
        derive = kj.isNotNull() & ~F.array_contains(names, "energy_kcal")
        extra = F.when(derive, F.array(F.struct(lit("energy_kcal").alias("key"),
                                                F.round(kj / KJ_PER_KCAL, 1).alias("value"))))
        return F.struct(
            source.alias("source"), basis.alias("basis_text"),
            F.map_from_entries(F.concat(first, F.coalesce(extra, F.slice(s, 1, 0)))).alias("per_100g"),
            rows.alias("rows"),
            F.when(derive, F.array(lit("energy_kcal"))).otherwise(F.expr("cast(array() as array<string>)")).alias("derived"))

    return let(stored, build)


def card_nutrition(page: P.Page, p: _Profile) -> Column:
    """The structured nutrition table, NULL without rows."""
    tables = page.pick_any(("#nic-eu-nutrition-facts-table",), ("#nic-nutrition-facts-table",),
                           ("#nic-eu-nutrition-facts", "table"))
    rows = F.transform(let(tables, lambda t: K.two_cell_rows(page, t)), lambda r: _row(
        r["label"], r["value"], number(r["value"], p.decimal), LB.nutrient_unit(r["value"]),
        LB.nutrient_key(r["label"], p.language)))
    basis = page.first_text(("#nic-nutrition-summary-serving",), ("#nic-eu-nutrition-facts-typical-values",))
    return let(rows, lambda r: F.when(F.size(r) > 0, _finish(r, basis, lit("nutrition_card"))))


def attribute_nutrition(pairs: Column, p: _Profile) -> Column:
    """Nutrients filed as attribute rows; one alone is no nutrition table."""
    def one(e: Column) -> Column:
        unit = F.coalesce(filled(LB.nutrient_unit(e["value"])),
                          F.when(F.lower(e["label"]).contains("kcal"), lit("kcal")).otherwise(lit("")))
        return _row(e["label"], e["value"], number(e["value"], p.decimal), unit,
                    LB.nutrient_key(e["label"], p.language))

    rows = F.filter(F.transform(F.filter(pairs, lambda e: matches(e["value"], NUTRIENT_VALUE)), one),
                    lambda r: r["key"].isNotNull() & r["amount"].isNotNull())
    serving = nth(F.filter(pairs, lambda e: F.coalesce(
        LB.attribute_key(e["label"], p.language) == "serving_size", lit(False))), 0)["value"]
    return let(rows, lambda r: F.when(F.size(r) >= 2, _finish(r, F.coalesce(serving, lit("")), lit("attributes"))))


def prose_rows(text: Column, p: _Profile) -> Column:
    """Nutrients of a prose text: alias, a number near it and a unit, longest alias first.

    One pass over the text finds every place where an alias is followed by an amount; what follows is read at those
    places only.  Aliases that are the beginning of longer ones are of the same nutrient, so the longest at a place counts.
    """
    return LB.per_language(p.language, lambda lang: _prose_rows(text, p, lang))


def _prose_rows(text: Column, p: _Profile, language: str) -> Column:
    options = sorted(L.aliases(L.NUTRIENT_ALIASES, language), key=lambda a: len(a[0]), reverse=True)
    names = "|".join(a for a, _ in options)
    amount = r"\b[^0-9<>]{0,24}?(\d[\d.,]*)\s*(kcal|kj|mg|g)\b"
    here = rf"(?iU)({names}){amount}"
    longest = max(len(a) for a, _ in options)
    rank = {a: i for i, (a, _) in enumerate(options)}
    pieces = F.split(text, rf"(?iU)(?=(?:{names}){amount})", -1)

    def hit(at: Column) -> Column:
        rest = F.substr(text, at, lit(longest + 400))
        window = lambda found: F.substr(
            text, F.greatest(at - 140, lit(1)), F.least(at - 1, lit(140)) + F.length(found) + 140)
        return let(F.struct(F.regexp_extract(rest, "^" + here, 0).alias("all"),
                            F.lower(F.regexp_extract(rest, "^" + here, 1)).alias("alias"),
                            group(rest, "^" + here, 2).alias("amount"), F.lower(group(rest, "^" + here, 3)).alias("unit")),
                   lambda h: F.struct(
                       lookup(rank, h["alias"]).alias("rank"), at.alias("at"),
                       _row(h["alias"], h["all"], number(h["amount"], p.decimal), h["unit"],
                            lookup(dict(options), h["alias"]), matches(window(h["all"]), BASIS)).alias("row")))

    def read(parts: Column) -> Column:
        ends = F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, lit(1), i), lit(1), lambda a, t: a + F.length(t)))
        starts = F.when(matches(nth(parts, 0), "^" + here), ends).otherwise(F.slice(ends, lit(2), F.size(ends)))
        found = F.array_sort(F.filter(F.transform(starts, hit), lambda h: h["rank"].isNotNull()))
        # The first place of an alias counts, and of a nutrient the first alias that has an amount.
        first = let(found, lambda hs: F.filter(hs, lambda h, i: ~F.coalesce(
            F.get(hs, i - 1)["rank"] == h["rank"], lit(False)) | (i == 0)))
        return F.filter(F.transform(first, lambda h: h["row"]), lambda r: r["amount"].isNotNull())

    rows = F.when(matches(text, rf"(?iU)(?:{names})"), let(pieces, read))
    return let(rows, lambda rs: F.filter(rs, lambda r, i: ~F.exists(
        F.slice(rs, lit(1), i), lambda q: _target(q["key"], q["unit"]) == r["key"])))


def prose_nutrition(candidates: Column, p: _Profile) -> Column:
    """The first candidate text (in order of trust) that states any nutrient."""
    def one(c: Column) -> Column:
        return let(prose_rows(c["text"], p), lambda rows: F.when(F.size(rows) > 0, _finish(
            rows, F.when(F.exists(rows, lambda r: r["basis_confirmed"]), lit("100 g")).otherwise(lit("")),
            F.concat(lit("text:"), c["source"]))))

    texts = F.filter(candidates, lambda c: F.coalesce(F.length(c["text"]) >= 10, lit(False)) & matches(c["text"], r"\d"))
    return nth(F.array_compact(F.transform(texts, one)), 0)


def _candidates(description: Column, aplus: Column, important: Column, listed: Column, pairs: Column) -> Column:
    def one(source: str, text: Column) -> Column:
        return F.struct(lit(source).alias("source"), text.alias("text"))

    return F.concat(
        F.array(one("description", description), one("aplus", aplus["text"])),
        F.transform(important, lambda s: one("important_information", s["text"])),
        F.array(one("feature_bullets", F.array_join(listed, " ")),
                one("raw_tables", F.array_join(F.transform(pairs, lambda e: F.concat(
                    e["label"], lit(": "), e["value"])), " "))))


# --- the listing -----------------------------------------------------------------

BLOCKS = ("raw_tables", "important_information", "feature_bullets", "description", "aplus", "ingredients",
          "nutrition", "media", "variation", "rating", "reviews", "package", "brand", "price", "unit_price",
          "breadcrumbs", "allergens")


def extract(pages: DataFrame, host: str | None, more: Callable[[P.Page], dict[str, Column]] | None = None) -> DataFrame:
    """Pages (html plus any lineage columns) to listings, by the rules of ``host``.

    Without a host each page brings its own rules (column ``_shop``).  No step shuffles: a page is one row from its
    source to its listing.  The source passes the reader beside its elements, so script data are read after it, only where
    they are asked for and never sent through it; then the source is dropped.  ``more`` gives further columns read off the same elements, which follow the listing's.
    """
    page, *passes = _passes(host)
    page = page.copy()
    extra = more(page) if more else {}
    out = P.tokenise(pages, page, keep=True)
    for columns in passes:
        out = out.withColumns(columns)
    lineage = [f for f in CRAWL_FIELDS if f in pages.columns]
    columns = {**_assembled(), "canonical_url": F.coalesce(
        "_canonical", F.col("canonical_url") if "canonical_url" in lineage else lit(None))}
    select = []
    for field in LISTING.fields:
        if field.name in columns:
            c = columns[field.name]
            if isinstance(c, dict):  # cast by member: a cast of the whole group would need all its blocks for one of them
                c = F.struct(*[c[f.name].cast(f.dataType).alias(f.name) for f in field.dataType.fields])
                select.append(c.alias(field.name))
                continue
        elif field.name in CRAWL_FIELDS and field.name not in lineage:
            c = lit(None)
        else:
            c = F.col(field.name)
        select.append(c.cast(field.dataType).alias(field.name))
    return out.select(*select, "page_error", *[c.alias(name) for name, c in extra.items()])


@lru_cache(maxsize=None)
def _passes(host: str | None) -> list:
    """The selectors' page and the projections from source to blocks, in order; built once per marketplace."""
    p, page, pairs = _Profile(host), P.Page(), F.col("_pairs")
    source = {"_gallery": K.image_records(F.col("html")), "_matrix": K.variation_matrix(F.col("html"))}
    blocks = {
        "title": page.first_text(("#productTitle",), ("#title",)),
        "_canonical": P.attr(page.first("link [rel=canonical]"), "href"),
        "_pairs": K.merged_pairs(K.table_pairs(page), K.bullet_pairs(page)),
        "_important": K.sections(page, "#important-information"),
        "_bullets": page.bullets("#feature-bullets", "ul", "li", "span .a-list-item"),
        "_description": page.first_text(("#productDescription",)),
        "_aplus": K.aplus(page),
        "byline_text": page.first_text(("#bylineInfo",)),
        "brand_url": F.coalesce(clean(P.attr(page.first("#bylineInfo"), "href")), lit("")),
        "price": price(page, p), "unit_price": unit_price(page, p), "rating": rating(page, p),
        "availability": page.first_text(("#availability", "span"), ("#availability",)),
        "seller": page.first_text(("#sellerProfileTriggerId",), ("#merchant-info", "a"), ("#merchant-info",)),
        "breadcrumbs": page.bullets("#wayfinding-breadcrumbs_feature_div", "ul", "li", "a"),
        "_shares": K.histogram(page, p.language),
        "_cards": K.review_cards(page, p.language, p.decimal, p.home),
        "_card_nutrition": card_nutrition(page, p),
        "_media": K.media(F.col("_gallery"), page)}
    derived = {
        "_ingredients": ingredients(page, F.col("_important"), F.col("attributes"), pairs, p),
        "_allergens": allergens(page, F.col("attributes")),
        "_nutrition": F.coalesce(
            F.col("_card_nutrition"), attribute_nutrition(pairs, p),
            prose_nutrition(_candidates(F.col("_description"), F.col("_aplus"), F.col("_important"),
                                        F.col("_bullets"), pairs), p)),
        "package": package(F.col("attributes"), F.col("title"), p),
        "brand": F.coalesce(filled(F.try_element_at("attributes", lit("brand"))),
                            LB.byline(F.col("byline_text"), p.language)),
        "media": F.col("_media.value"), "variation": F.when(F.col("_matrix.error").isNull(), F.col("_matrix.value")),
        "reviews": K.review_block(F.col("_shares"), F.col("_cards"), F.col("rating.count"))}
    return [page, source, blocks, {"attributes": K.canonical(pairs, p.language)}, derived]


@lru_cache(maxsize=None)
def _assembled() -> dict[str, Column | dict[str, Column]]:
    """The nested groups of a listing and its block log, by member."""
    pairs = F.col("_pairs")
    present = {
        "raw_tables": F.size(pairs) > 0, "important_information": F.size("_important") > 0,
        "feature_bullets": F.size("_bullets") > 0, "description": F.col("_description") != "",
        "aplus": F.col("_aplus").isNotNull(), "ingredients": F.col("_ingredients").isNotNull(),
        "nutrition": F.col("_nutrition").isNotNull(), "media": F.col("media").isNotNull(),
        "variation": F.col("variation").isNotNull(), "rating": F.col("rating").isNotNull(),
        "reviews": F.col("reviews").isNotNull(), "package": F.col("package").isNotNull(),
        "brand": F.col("brand") != "", "price": F.col("price").isNotNull(),
        "unit_price": F.col("unit_price").isNotNull(), "breadcrumbs": F.size("breadcrumbs") > 0,
        "allergens": F.size("_allergens") > 0}
    listed = {k: F.coalesce(c, lit(False)) for k, c in present.items()}
    # A block that fails is neither present nor absent, and the page's other blocks stand.
    failed = {"media": F.col("_media.error"), "variation": F.col("_matrix.error")}
    state = {b: failed[b].isNull() if b in failed else lit(True) for b in BLOCKS}
    errors = F.array(F.struct(lit("page").alias("block"), F.col("page_error").alias("error")), *[
        F.struct(lit(b).alias("block"), c.alias("error")) for b, c in failed.items()])
    log = {
        "blocks_present": F.array_compact(F.array(*[F.when(state[b] & listed[b], lit(b)) for b in BLOCKS])),
        "blocks_absent": F.array_compact(F.array(*[F.when(state[b] & ~listed[b], lit(b)) for b in BLOCKS])),
        "errors": F.filter(errors, lambda e: e["error"].isNotNull())}
    return {
        "schema_version": lit(SCHEMA_VERSION),
        "raw_tables": F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["label"], e["value"]))),
        "attribute_sources": F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["label"], e["source"]))),
        "content": {"feature_bullets": F.col("_bullets"), "description": F.col("_description"),
                    "important_information": F.col("_important"), "aplus": F.col("_aplus")},
        "food": {"ingredients": F.col("_ingredients"), "allergens": F.col("_allergens"), "nutrition": F.col("_nutrition")},
        "extraction": log}


def accepted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (with their source) that hold a product, and the rest with the reason, to be split before extraction."""
    gated = pages.withColumn("_html", F.col("html"))
    gated = P.gate(gated).withColumnRenamed("_html", "html").drop(*P.READ)
    fine = F.col("challenge").isNull() & ~F.col("parse_failed") & F.col("page_error").isNull()
    return gated.where(fine).select(*pages.columns), gated.where(~fine)


#: Manifests that are sent to every task; each is a run id and three short texts, so some 20 MB.
MANIFESTS = 200_000
#: Parts that the pages of a run are dealt over where there are more manifests.
SALTS = 64


def with_manifests(pages: DataFrame, run: DataFrame) -> DataFrame:
    """Pages with ``_marketplace``, ``_locale`` and ``_accept`` of their run's manifest, NULL without one.

    Up to ``MANIFESTS`` runs go to the pages, which are not moved.  Beyond, both sides are shuffled, a run's pages over
    ``SALTS`` parts.
    """
    about = run.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max(F.struct(
        F.col("marketplace").alias("_marketplace"), F.col("locale.language").alias("_locale"),
        F.col("locale.accept_language").alias("_accept"))).alias("_m")).select("run_id", "_m.*")
    if about.limit(MANIFESTS + 1).count() <= MANIFESTS:
        return pages.join(F.broadcast(about), "run_id", "left")
    salted = about.withColumn("_salt", F.explode(F.sequence(lit(0), lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("asin", "fetched_at"), lit(SALTS)).cast("int")).join(
        salted, ["run_id", "_salt"], "left").drop("_salt")


def reextract(pages: DataFrame, run: DataFrame, host: str, feed: DataFrame | None = None) -> DataFrame:
    """Extract retained pages again and give them the lineage of the crawl that found them.

    ``pages`` is (asin, run_id, html, fetched_at); ``run`` the manifests.  A page is read by the
    rules of its manifest's marketplace, which it carries as a value, so pages of all shops are one scan and one
    plan; ``host`` is for pages whose run names none.  Of a shop without rules of its own, those for any other host are used.
    The feed is joined to the listings, by the keys its records have (``merge.lineage``).  Pages that could
    not be read keep their row with ``page_error``.
    """
    base = with_manifests(pages, run)
    link = F.concat(lit("https://"), F.coalesce("_marketplace", lit("")), lit("/dp/"), F.col("asin"))
    base = base.select(
        "asin", "run_id", "html", "fetched_at", F.coalesce("_marketplace", lit("")).alias("marketplace"),
        link.alias("product_url"), link.alias("canonical_url"), F.coalesce("_locale", lit("")).alias("locale"),
        F.coalesce("_accept", lit("")).alias("accept_language"))
    shop = F.coalesce(filled(F.trim("marketplace")), lit(host))
    records = extract(base.withColumn("_shop", LB.profile(shop)), None)
    return records if feed is None else merge.lineage(records, feed, [f for f in CRAWL_FIELDS if f in feed.columns
                                                                      and f != "asin"])


def block_status(listings: DataFrame) -> DataFrame:
    """One row per listing and block: present, absent or error."""
    def rows(c: str, state: str) -> Column:
        return F.transform(F.col(f"extraction.{c}"), lambda b: F.struct(
            b.alias("block"), lit(state).alias("state"), lit(None).cast("string").alias("error")))

    failed = F.transform(F.col("extraction.errors"), lambda e: F.struct(
        e["block"].alias("block"), lit("error").alias("state"), e["error"].alias("error")))
    blocks = F.concat(rows("blocks_present", "present"), rows("blocks_absent", "absent"), failed)
    return unfold(listings, blocks, "b", "asin").select("asin", "b.*")
