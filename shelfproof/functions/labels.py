"""Locale-aware label, review and price-text columns.

``language`` arguments may be a Python string or a column.  The per-language
branches are literal patterns, so each compiles once per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.functions.text import IU, clean, group, lookup, matches, number, squeeze
from shelfproof.functions.values import cases, col, filled, let, lit
from shelfproof.rules import locale as L

LANGUAGES = ("de", "en")


def per_language(language, build) -> Column:
    """``build(lang)`` of the row's language; a plain string picks one branch."""
    if isinstance(language, str):
        return build(language)
    out = None
    for lang in LANGUAGES:
        out = F.when(language == lang, build(lang)) if out is None else out.when(language == lang, build(lang))
    return out


def normal_label(c: Column) -> Column:
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return squeeze(F.lower(F.regexp_replace(trimmed, r"^:+|:+$", "")))


def attribute_key(label: Column, language="de") -> Column:
    """Canonical key of a label by exact match after normalising, else NULL."""
    return per_language(language, lambda lang: lookup(
        dict(L.aliases(L.ATTRIBUTE_ALIASES, lang)), normal_label(label)))


def nutrient_key(label: Column, language="de") -> Column:
    """Exact alias, else the longest alias the label contains."""
    text = F.trim(F.regexp_replace(normal_label(label), r"^[—\- ]+", ""))

    def build(lang: str) -> Column:
        pairs = dict(L.aliases(L.NUTRIENT_ALIASES, lang))
        longest = sorted(pairs, key=len, reverse=True)
        return let(text, lambda t: F.coalesce(
            lookup(pairs, t), *[F.when(t.contains(a), lit(pairs[a])) for a in longest]))

    return per_language(language, build)


def is_ingredient_heading(heading: Column, language="de") -> Column:
    return per_language(language, lambda lang: F.coalesce(
        normal_label(heading).rlike("|".join(L.INGREDIENT_HEADINGS[lang])), lit(False)))


def byline(c: Column, language="de") -> Column:
    def build(lang: str) -> Column:
        out = F.trim(F.coalesce(c, lit("")))
        for pattern in L.BYLINE_PATTERNS[lang]:
            out = F.trim(F.regexp_replace(out, IU + pattern, ""))
        return F.regexp_replace(out, r"^[ :]+|[ :]+$", "")

    return per_language(language, build)


def dateline(c: Column, language="de", home_country=None) -> Column:
    """``STRUCT<country, date, home>`` of a review's dateline.

    ``home`` is NULL when the line is not understood or the country of the
    marketplace is unknown.
    """
    def build(lang: str) -> Column:
        pattern = IU + L.DATELINE[lang]

        def part(name: str) -> Column:
            return F.coalesce(*[group(c, pattern, i) for i in L.DATELINE_GROUPS[lang][name]])

        month = lookup({m: i + 1 for i, m in enumerate(L.MONTHS[lang])},
                       F.rtrim(F.lower(part("month")), lit(".")))
        read = F.struct(F.trim(group(c, pattern, 1)).alias("country"), month.alias("month"))

        def line(x: Column) -> Column:
            country, month = x["country"], x["month"]
            date = F.try_to_date(F.format_string(
                "%04d-%02d-%02d", part("year").try_cast("int"), month, part("day").try_cast("int")))
            return F.struct(
                country.alias("country"),
                F.when(month.isNotNull(), date).alias("date"),
                F.when(country.isNotNull() & col(home_country).isNotNull(),
                       F.lower(country) == col(home_country)).alias("home"))

        return let(read, line)

    return per_language(language, build)


def is_verified(c: Column, language="de") -> Column:
    return per_language(language, lambda lang: F.coalesce(
        F.lower(c).rlike("|".join(L.VERIFIED_PURCHASE[lang])), lit(False)))


def helpful_votes(c: Column, language="de") -> Column:
    """Votes shown, 1 for the spelled-out singular, NULL when none are shown."""
    def build(lang: str) -> Column:
        digits = F.regexp_replace(group(c, IU + L.HELPFUL_MANY[lang], 1), r"\D", "")
        return F.when(matches(F.trim(c), IU + L.HELPFUL_ONE[lang]), lit(1).cast("bigint")) \
                .otherwise(digits.try_cast("bigint"))

    return per_language(language, build)


def histogram_share(c: Column, language="de") -> Column:
    """``STRUCT<stars, percent>`` of one histogram bar's label, else NULL."""
    def build(lang: str) -> Column:
        pattern = IU + L.HISTOGRAM_LABEL[lang]
        return F.when(matches(c, pattern), F.struct(
            group(c, pattern, 2).try_cast("int").alias("stars"),
            group(c, pattern, 1).try_cast("int").alias("percent")))

    return per_language(language, build)


def without_noise(c: Column, language="de") -> Column:
    """Review body without the buttons rendered inside it."""
    return per_language(language, lambda lang: F.trim(squeeze(F.regexp_replace(
        F.coalesce(c, lit("")), IU + "|".join(L.REVIEW_NOISE[lang]), " "))))


def host_key(c: Column) -> Column:
    """``https://www.example.com/x`` and ``www.example.com/`` both give ``example.com``."""
    host = F.rtrim(F.lower(F.trim(F.coalesce(c, lit("")))), lit("/"))
    host = F.when(host.contains("://"), F.regexp_extract(host, r"://([^/?#]*)", 1)).otherwise(host)
    return F.regexp_replace(host, r"^www\.", "")


def profile(host: Column) -> Column:
    """``STRUCT<language, currency, decimal, home>`` of a marketplace, or the fallback's."""
    def row(entry) -> Column:
        return F.struct(*[lit(x).alias(n) for n, x in
                          zip(("language", "currency", "decimal", "home"), entry)])

    key = host_key(host)
    return cases(*[(key == h, row(entry)) for h, entry in L.MARKETPLACES.items()],
                 otherwise=row(L.FALLBACK))


def currency(c: Column, fallback="EUR") -> Column:
    return cases(*[(c.contains(sign), lit(code)) for sign, code in L.CURRENCY_SIGNS],
                 otherwise=col(fallback))


def has_decimal(c: Column) -> Column:
    return matches(c, r"\d[.,]\d")


def price_head(c: Column) -> Column:
    """The price itself, without a savings clause behind it."""
    head = group(c, r"(?U)^\s*([^\d]{0,3}[\d][\d.,\s]*\s*[^\w\s]{0,3})", 1)
    return F.when(head.isNotNull(), clean(head)).otherwise(c)


def nutrient_unit(c: Column) -> Column:
    return F.lower(F.coalesce(group(c, r"(?i)(kcal|kj)", 1),
                              group(c, r"(?i)\d\s*(mg|g|ml)\b", 1), lit("")))


def product_ids(c: Column) -> Column:
    """Distinct product ids of a ``;``-separated list of ids or links, in order."""
    items = F.filter(F.transform(F.split(F.coalesce(c, lit("")), "[;,]"), lambda i: F.trim(i)),
                     lambda i: F.length(i) > 0)

    def one(item: Column) -> Column:
        return F.coalesce(
            group(item, L.ASIN_LINK, 1), group(item, "^(" + L.ASIN_BARE + ")$", 1),
            F.raise_error(F.concat(item, lit(": neither a product id nor a product link"))))

    return F.array_distinct(F.transform(items, one))


def locale_status(accept_language: Column, expected: Column) -> Column:
    """``STRUCT<language, status>``: does the asked locale fit the marketplace?"""
    header = F.trim(F.coalesce(accept_language, lit("")))
    primary = filled(F.regexp_extract(F.lower(header), r"^\s*([^;,\-]*)", 1))
    return F.struct(
        F.when(header != "", F.trim(primary)).alias("language"),
        cases((header == "", lit("unset")),
              (F.coalesce(F.trim(primary) == expected, lit(False)), lit("matches")),
              otherwise=lit("conflict")).alias("status"))


def sponsored_markers(css_class: Column, has_label: Column, has_redirect: Column) -> Column:
    """Which of the three placement markers a result tile carries."""
    return F.array_compact(F.array(
        F.when(F.coalesce(css_class.contains("AdHolder"), lit(False)), lit("ad_holder")),
        F.when(F.coalesce(has_label, lit(False)), lit("sponsored_label")),
        F.when(F.coalesce(has_redirect, lit(False)), lit("sspa_link"))))
