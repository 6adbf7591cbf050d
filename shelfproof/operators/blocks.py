"""The structural shapes of a product page, as columns over its elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.functions import labels as LB
from shelfproof.functions.text import clean, group, matches, number
from shelfproof.functions.values import cases, col, filled, let, lit, nth
from shelfproof.operators import pages as P
from shelfproof.rules import locale as L

# Where attribute tables and label/value bullets stand.
TABLES = (
    ("#productOverview_feature_div", "table"), ("#poExpander", "table"),
    ("table .a-normal .a-spacing-micro",), ("#productDetails_techSpec_section_1",),
    ("#productDetails_techSpec_section_2",), ("#productDetails_detailBullets_sections1",),
    ("#prodDetails", "table"), ("#technicalSpecifications_feature_div", "table"),
)
BULLETS = (("#detailBullets_feature_div", "li"), ("#detailBulletsWrapper_feature_div", "li"),
           ("#productFactsDesktop_feature_div", ".a-fixed-left-grid"))
APLUS = (("#aplus",), ("#aplus_feature_div",), ("#aplusBrandStory_feature_div",), ("#aplus3p_feature_div",))
PLACEHOLDER = r"grey-pixel|transparent-pixel|loading-|\.gif($|\?)"
MODULE_PREFIX = r"^(?:premium-module-|aplus-module-|brand-story-|apm-)"

#: A JSON value that is neither empty nor a list or an object.
SCALAR = r'^(?:-?\d|true|"[^"])'

PAIR = "array<struct<label: string, value: string>>"


def unlabelled(text: Column) -> Column:
    """A label without its trailing colon."""
    return F.trim(F.regexp_replace(text, r":+$", ""))


def two_cell_rows(page: P.Page, tables: Column) -> Column:
    """(label, value) of every row with exactly two cells; duplicates stay."""
    rows = page.pick("tr")

    def row(tr: Column) -> Column:
        return let(page.cells(tr), lambda two: F.when(
            F.size(two) == 2, F.struct(
                unlabelled(page.text_of(nth(two, 0))).alias("label"),
                page.text_of(nth(two, 1)).alias("value"))))

    read = let(rows, lambda rs: F.flatten(F.transform(tables, lambda t: F.array_compact(F.transform(
        F.filter(rs, lambda tr: P.inside(tr, t)), row)))))
    return F.filter(read, lambda p: (p["label"] != "") & (p["value"] != ""))


def table_pairs(page: P.Page) -> Column:
    """Rows of the attribute tables, each table once."""
    return let(page.pick_any(*TABLES), lambda tables: two_cell_rows(page, tables))


def bullet_pairs(page: P.Page) -> Column:
    """Label/value bullets: two spans side by side, or ``Label : Value`` in one text."""
    split = r"^(.{2,60}?)\s*:\s*(.+)$"

    def one(item: Column) -> Column:
        def pair(own: Column) -> Column:
            lists = F.filter(own, lambda s: P.carries(s, ".a-list-item"))
            inner = let(lists, lambda ls: F.filter(own, lambda s: F.exists(
                ls, lambda p: s["parent"] == p["ord"])))
            return let(F.struct(inner.alias("inner"), page.text_of(item).alias("text")), lambda x: F.when(
                F.size(x["inner"]) >= 2, F.struct(
                    unlabelled(page.text_of(nth(x["inner"], 0))).alias("label"),
                    page.text_of(nth(x["inner"], 1)).alias("value")))
                .otherwise(F.struct(
                    F.trim(F.regexp_extract(x["text"], split, 1)).alias("label"),
                    F.trim(F.regexp_extract(x["text"], split, 2)).alias("value"))))

        return let(page.pick("span", within=item), pair)

    return F.filter(F.transform(page.pick_any(*BULLETS), one), lambda p: (p["label"] != "") & (p["value"] != "")
                    & (F.length(p["label"]) <= 80))


def merged_pairs(tables: Column, listed: Column) -> Column:
    """Labels in order with their block; a table's value beats a bullet's, the first one wins."""
    tagged = F.concat(
        F.transform(tables, lambda p: F.struct(p["label"], p["value"], lit("table").alias("source"))),
        F.transform(listed, lambda p: F.struct(p["label"], p["value"], lit("detail_bullets").alias("source"))))
    return let(tagged, lambda all_: let(F.transform(all_, lambda p: p["label"]), lambda names: F.filter(
        all_, lambda p, i: F.array_position(names, p["label"]) == i + 1)))


def canonical(pairs: Column, language: str) -> Column:
    """Canonical key -> value, the first label of each key wins."""
    keyed = F.filter(F.transform(pairs, lambda p: F.struct(
        LB.attribute_key(p["label"], language).alias("key"), p["value"].alias("value"))),
        lambda p: p["key"].isNotNull())
    return let(keyed, lambda ks: F.map_from_entries(let(F.transform(ks, lambda p: p["key"]), lambda names: F.filter(
        ks, lambda p, i: F.array_position(names, p["key"]) == i + 1))))


def sections(page: P.Page, container: str, section: str = ".a-section") -> Column:
    """Heading and body of the innermost sections of a container."""
    heads = [("h1",), ("h2",), ("h3",), ("h4",), ("h5",), (".a-text-bold",)]

    def one(s: Column) -> Column:
        first = F.array_min(page.places_any(*heads, within=s))
        heading = F.coalesce(F.when(first.isNotNull(), page.text_of(page.at(first))), lit(""))
        return let(F.struct(heading.alias("heading"), page.lines_of(s).alias("lines")), lambda x: F.struct(
            x["heading"].alias("heading"),
            clean(F.array_join(F.when(
                (x["heading"] != "") & (nth(x["lines"], 0) == x["heading"]),
                F.slice(x["lines"], lit(2), F.greatest(F.size(x["lines"]), lit(1)))).otherwise(x["lines"]), " "))
            .alias("text")))

    found = page.pick(container, section)
    # Ranges are nested or apart, so a section is innermost if the next one does not start inside it.
    leaves = let(found, lambda fs: F.filter(fs, lambda s, i: F.coalesce(
        F.get(fs, i + 1)["ord"] > s["last"], lit(True))))
    return F.filter(F.transform(leaves, one), lambda s: s["text"] != "")


def expanders(page: P.Page, container: str) -> Column:
    """Heading and body of collapsible sections."""
    def text(of: str, e: Column) -> Column:
        return let(page.places(of, within=e), lambda p: F.when(
            F.size(p) > 0, page.text_of(page.at(nth(p, 0)))).otherwise(lit("")))

    def one(e: Column) -> Column:
        return F.struct(text(".a-expander-prompt", e).alias("heading"), text(".a-expander-content", e).alias("text"))

    return F.filter(F.transform(page.pick(container, ".a-expander-container"), one),
                    lambda s: (s["heading"] != "") | (s["text"] != ""))


# --- embedded JSON -------------------------------------------------------------

#: A block's value and, where its data cannot be read as the block, what is wrong with them.
IMAGE = ("hiRes", "large", "thumb", "variant", "altText")


def _shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def _record(v: Column) -> Column:
    """A gallery record; ``odd`` if its size map is needed and holds something other than sizes."""
    texts = {k: F.try_variant_get(v, f"$.{k}", "string") for k in IMAGE}
    sizes = F.try_variant_get(v, "$.main", "map<string, variant>")
    main = F.try_variant_get(v, "$.main", "map<string, array<int>>")
    shown = F.coalesce(filled(texts["hiRes"]), filled(texts["large"]))
    odd = shown.isNull() & F.coalesce(F.exists(F.map_values(sizes), lambda s: ~_shape(s).startswith("ARRAY<")
                                               & (_shape(s) != "VOID")), lit(False))
    return F.struct(*[c.alias(k) for k, c in texts.items()], main.alias("main"), odd.alias("odd"))


def _from(text: Column, word: str) -> Column:
    """The text from the character in front of the first ``word`` on, NULL without one.

    A pattern that is one character and then the word matches here what it matches in the whole text, and has not to try
    every place in front of it.
    """
    return F.when(text.contains(word), F.substr(text, F.greatest(F.locate(word, text) - 1, lit(1))))


def image_records(html: Column) -> Column:
    """``STRUCT<records, error>``: the gallery, quoted as a script string or written as a literal.

    The JSON reader stops at the end of the first value, so what follows the gallery in the script, and what looks like
    the end of the string inside a label, do not matter; the text is read once, from the gallery's name on.
    """
    start = r"""(?s)['"]colorImages['"]\s*:\s*\{\s*['"]initial['"]\s*:\s*"""
    rest = group(_from(html, "colorImages"), start + r"(A\.\$\.parseJSON\(\s*'.*?(?:</script|\z)|\[.*)", 1)

    def text(found: Column) -> Column:
        unescaped = F.replace(F.replace(F.replace(
            F.regexp_replace(found, r"^A[^']*'", ""), lit("\\'"), lit("'")), lit('\\"'), lit('"')), lit("\\\\"), lit("\\"))
        return F.when(found.startswith("["), found).when(matches(found, r"(?s)^A[^']*'.*(?<!\\)'\s*\)"), unescaped)

    def read(items: Column) -> Column:
        return let(F.transform(items, lambda v: F.when(_shape(v).startswith("OBJECT<"), _record(v))), lambda rs: F.struct(
            rs.alias("records"), cases(
                (F.exists(rs, lambda r: r.isNull()), lit("a gallery record is not an object")),
                (F.exists(rs, lambda r: r["odd"]), lit("a gallery record's sizes are not lists")),
                otherwise=lit(None).cast("string")).alias("error")))

    return let(rest, lambda found: let(F.from_json(text(found), "array<variant>"), read))


def is_placeholder(url: Column) -> Column:
    return F.coalesce(url == "", lit(True)) | matches(url, PLACEHOLDER)


def widest(sizes: Column) -> Column:
    """The key with the largest first number."""
    return F.array_max(F.transform(F.map_entries(sizes), lambda e: F.struct(
        F.coalesce(nth(e["value"], 0), lit(0)).alias("width"), e["key"].alias("url"))))["url"]


def best_image(record: Column) -> Column:
    return F.coalesce(filled(record["hiRes"]), filled(record["large"]),
                      widest(record["main"]), F.coalesce(record["thumb"], lit("")))


def dynamic_images(page: P.Page) -> Column:
    """``STRUCT<urls, error>``: the main image's size maps, for pages without a gallery."""
    places = F.array_sort(page.places_any(("#landingImage",), ("#imgBlkFront",), ("img",)))
    blobs = F.filter(F.transform(places, lambda i: P.attr(page.at(i), "data-a-dynamic-image")), lambda b: b.isNotNull())
    read = F.transform(blobs, lambda b: F.struct(
        widest(F.from_json(b, "map<string, array<int>>")).alias("url"),
        (F.coalesce(F.size(F.from_json(b, "map<string, string>")) > 0, lit(False))
         & F.from_json(b, "map<string, array<int>>").isNull()).alias("odd")))
    return let(read, lambda rs: F.struct(
        F.array_compact(F.transform(rs, lambda r: r["url"])).alias("urls"),
        F.when(F.exists(rs, lambda r: r["odd"]), lit("an image's sizes are not lists")).alias("error")))


def media(gallery: Column, page: P.Page) -> Column:
    """``STRUCT<value, error>``: the gallery's images, without any the main image's."""
    shown = F.filter(F.transform(gallery["records"], lambda r: F.struct(
        best_image(r).alias("url"), F.coalesce(r["variant"], lit("")).alias("variant"),
        clean(r["altText"]).alias("alt"), F.coalesce(r["thumb"], lit("")).alias("thumb"))),
        lambda i: i["url"] != "")
    failed = gallery["error"].isNotNull()

    def block(images: Column, source: str) -> Column:
        return F.when(F.size(images) > 0, F.struct(
            images.alias("images"), nth(images, 0)["url"].alias("primary_image"),
            F.size(images).alias("image_count"), lit(source).alias("image_source")))

    def result(value: Column, error: Column) -> Column:
        return F.struct(value.alias("value"), error.alias("error"))

    def fallback(dynamic: Column) -> Column:
        images = F.transform(dynamic["urls"], lambda u: F.struct(
            u.alias("url"), lit("").alias("variant"), lit("").alias("alt"), lit("").alias("thumb")))
        return result(F.when(dynamic["error"].isNull(), block(images, "dynamic_image")), dynamic["error"])

    nothing = lit(None).cast("string")
    return let(F.when(~failed, shown), lambda images: cases(
        (F.coalesce(F.size(images) > 0, lit(False)), result(block(images, "color_images"), nothing)),
        (failed, result(F.when(F.size(images) > 0, block(images, "color_images")), gallery["error"])),
        otherwise=let(dynamic_images(page), fallback)))


MATRIX = ("dimensions", "variation_values", "display_labels", "values_by_asin", "current_asin", "parent_asin",
          "total_variations")


def variation_matrix(html: Column) -> Column:
    """``STRUCT<value, error>``: the family matrix, decoded key by key from just before its display data on.

    A key whose JSON is broken is left out; one that decodes to another shape than its own is an error of the block.
    """
    anchor = F.locate("dimensionValuesDisplayData", html)
    chunk = F.substr(html, F.greatest(anchor - 4000, lit(1)))
    keys = {"dimensions": ("dimensions", "array<string>"), "variation_values": ("variationValues", "map<string, array<string>>"),
            "display_labels": ("variationDisplayLabels", "map<string, string>"),
            "values_by_asin": ("dimensionValuesDisplayData", "map<string, array<string>>")}

    def read(c: Column) -> Column:
        def named(key: str, value: str) -> Column:
            return group(_from(c, key), rf"""["']{key}["']\s*:\s*{value}""", 1)

        def rest(key: str) -> Column:
            """All that follows a key; the pattern reads the key only, which stands where its match is first found."""
            return let(_from(c, key), lambda t: let(F.regexp_extract(t, rf"""["']{key}["']\s*:\s*""", 0), lambda m: F.when(
                m != "", filled(F.substr(t, F.position(m, t) + F.length(m))))))

        def decoded(key: str, schema: str) -> Column:
            """Value and whether the JSON is there, is not empty and has another shape."""
            def other(text: Column) -> Column:
                return F.coalesce(F.size(F.from_json(text, "map<string, variant>")) > 0,
                                  F.size(F.from_json(text, "array<variant>")) > 0, matches(text, SCALAR))

            return let(rest(key), lambda text: let(F.from_json(text, schema), lambda v: F.struct(
                F.when(F.size(v) > 0, v).alias("value"),
                F.when(text.isNotNull() & v.isNull(), other(text)).otherwise(lit(False)).alias("odd"))))

        parts = F.struct(*[decoded(*spec).alias(name) for name, spec in keys.items()])
        def whole(d: Column) -> Column:
            return F.struct(*[d[name]["value"].alias(name) for name in keys],
                            named("currentAsin", '"([^"]*)"').alias("current_asin"),
                            named("parentAsin", '"([^"]*)"').alias("parent_asin"),
                            named("num_total_variations", r'"?(\d+)').try_cast("int").alias("total_variations"))

        # A matrix of which no key is filled is none.
        return let(parts, lambda d: F.struct(
            let(whole(d), lambda v: F.when(F.coalesce(*[v[n].cast("string") for n in MATRIX]).isNotNull(), v)).alias("value"),
            cases(*[(d[name]["odd"], lit(f"{spec[0]} does not have its shape")) for name, spec in keys.items()],
                  otherwise=lit(None).cast("string")).alias("error")))

    return F.when(html.contains("dimensionValuesDisplayData"), let(chunk, read))


# --- enhanced content -------------------------------------------------------------

def aplus(page: P.Page) -> Column:
    def build(outer: Column) -> Column:
        def own(*steps: str) -> Column:
            """Elements of the modules, in page order; the outermost modules are apart."""
            return F.flatten(F.transform(outer, lambda m: page.elements(F.array_sort(page.places_any(
                *[(s,) for s in steps], within=m)))))

        types = F.array_distinct(F.flatten(F.transform(
            own(".aplus-module", ".apm-brand-story-card"),
            lambda e: F.filter(F.split(P.attr(e, "class"), r"\s+"), lambda k: k.rlike(MODULE_PREFIX)))))
        heads = own("h1", "h2", "h3", "h4", ".aplus-h1", ".aplus-h2", ".aplus-h3")
        images = F.transform(own("img"), lambda e: F.struct(
            F.coalesce(filled(P.attr(e, "data-src")), P.attr(e, "src"), lit("")).alias("url"),
            clean(P.attr(e, "alt")).alias("alt")))
        shown = F.filter(images, lambda i: ~is_placeholder(i["url"]))
        tables = F.transform(own("table"), lambda t: F.filter(F.transform(
            page.pick("tr", within=t), lambda tr: F.transform(page.cells(tr), page.text_of)),
            lambda r: F.exists(r, lambda c: c != "")))
        text = clean(F.array_join(F.array_distinct(F.flatten(F.transform(outer, page.lines_of))), " "))
        return F.struct(
            types.alias("module_types"),
            F.array_distinct(F.filter(page.texts_of(heads), lambda h: F.length(h) < 200)).alias("headings"),
            text.alias("text"), F.length(text).alias("text_length"),
            let(shown, lambda s: let(F.transform(s, lambda i: i["url"]), lambda urls: F.filter(
                s, lambda i, n: F.array_position(urls, i["url"]) == n + 1))).alias("images"),
            F.filter(tables, lambda t: F.size(t) > 1).alias("tables"))

    modules = page.elements(F.array_sort(page.places_any(*APLUS)))
    outer = let(modules, lambda ms: F.filter(ms, lambda m: ~F.exists(ms, lambda o: P.inside(m, o))))
    return let(outer, lambda ms: F.when(F.size(ms) > 0, build(ms)))


# --- reviews ---------------------------------------------------------------------

def histogram(page: P.Page, language) -> Column:
    """Percent per star level; the first bar of a level wins."""
    bars = page.elements(F.array_sort(page.places_any(
        ("#histogramTable", "a"), (".cr-widget-TitleRatingsHistogram", "a"), ("#cm_cr_dp_d_rating_histogram", "a"))))
    shares = F.array_compact(F.transform(bars, lambda e: LB.histogram_share(P.attr(e, "aria-label"), language)))

    def read(found: Column) -> Column:
        stars = F.transform(found, lambda s: s["stars"])
        kept = F.filter(found, lambda s, i: (F.array_position(stars, s["stars"]) == i + 1)
                        & s["stars"].between(1, 5))
        return F.map_from_entries(F.transform(kept, lambda s: F.struct(cases(
            *[(s["stars"] == n, lit(k)) for n, k in L.STAR_KEYS.items()], otherwise=lit("")).alias("key"),
            s["percent"].alias("value"))))

    return let(shares, read)


def review_cards(page: P.Page, language, decimal, home) -> Column:
    """Every review card that states a rating or a text."""
    def one(r: Column) -> Column:
        stars = page.first_text(("i [data-hook=review-star-rating]", "span"),
                                ("[data-hook=review-star-rating]", ".a-icon-alt"),
                                ("[data-hook=cmps-review-star-rating]", ".a-icon-alt"), within=r)
        date_text = page.first_text(("span [data-hook=review-date]",), within=r)
        titles = page.places_any(("h5 [data-hook=reviewTitle]",), ("a [data-hook=review-title]",),
                                 ("span [data-hook=review-title]",), within=r)
        strip = page.first_text(("a [data-hook=format-strip]",), ("[data-hook=format-strip-linkless]",), within=r)

        def body_of(node: Column) -> Column:
            hidden = page.pick(".a-teaser-describedby", within=node)
            text = F.aggregate(hidden, page.raw_text(node), lambda acc, h: F.replace(acc, page.raw_text(h), lit("")))
            return LB.without_noise(F.translate(text, P.SEPARATOR, " "), language)

        def body(step: str) -> Column:
            return let(page.places(step, within=r), lambda p: F.when(
                F.size(p) > 0, filled(let(page.at(nth(p, 0)), body_of))))

        bodies = F.coalesce(*[body(s) for s in (
            "span [data-hook=review-body]", "div [data-hook=reviewText]", "span [data-hook=review-collapsed]")], lit(""))
        read = F.struct(stars.alias("stars"), date_text.alias("date_text"), titles.alias("titles"), strip.alias("strip"),
                        bodies.alias("body"), LB.dateline(date_text, language, home).alias("line"))

        def card(x: Column) -> Column:
            title = clean(F.array_join(F.filter(F.flatten(F.transform(
                x["titles"], lambda t: page.own_nodes(page.at(t)))),
                lambda t: ~t.contains("Sternen") & ~t.contains("out of 5")), " "))
            strip, line = x["strip"], x["line"]
            return F.struct(
                F.coalesce(P.attr(r, "id"), lit("")).alias("id"),
                number(group(x["stars"], r"(\d+(?:[.,]\d+)?)", 1), decimal).alias("rating"),
                x["stars"].alias("rating_text"), title.alias("title"),
                F.coalesce(P.attr(page.at(F.array_min(x["titles"])), "lang"), lit("")).alias("language"),
                F.coalesce(line["date"].cast("string"), lit("")).alias("date"), x["date_text"].alias("date_text"),
                F.coalesce(line["country"], lit("")).alias("country"), line["home"].alias("home_marketplace"),
                F.when(strip.contains(":"), F.trim(F.regexp_extract(strip, r"^[^:]*:(.*)$", 1))).otherwise(strip).alias("variant"),
                LB.is_verified(page.first_text(("span [data-hook=avp-badge]",), within=r), language).alias("verified"),
                LB.helpful_votes(page.first_text(("span [data-hook=helpful-vote-statement]",), within=r),
                                 language).alias("helpful_votes"),
                x["body"].alias("text"))

        return let(read, card)

    found = page.elements(F.array_sort(page.places_any(("div [data-hook=review]",), ("div [data-hook=cmps-review]",))))
    return F.filter(F.transform(found, one), lambda c: c["rating"].isNotNull() | (c["text"] != ""))


def review_block(shares: Column, cards: Column, count: Column) -> Column:
    home = F.size(F.filter(cards, lambda c: F.coalesce(c["home_marketplace"], lit(True))))
    return F.when((F.size(cards) > 0) | (F.size(shares) > 0), F.struct(
        shares.alias("histogram_percent"), cards.alias("sample"), F.size(cards).alias("sample_size"),
        home.alias("sample_home"), count.cast("bigint").alias("rating_count"),
        lit("pdp_widget").alias("sample_source")))
