"""The whole trust pass over a listing, in its fixed order, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfproof.functions.values import lit
from shelfproof.operators import nutrition, pricing, quantity, reviews, variation

CONTRACT_VERSION = 1


@dataclass(frozen=True)
class Profile:
    """What a category may tell the generic rules: ranges, nothing procedural."""

    key: str = "product"
    label: str = "product"
    nutrition_bands: dict = field(default_factory=dict)
    price_band: tuple | None = None


NEUTRAL = Profile()


def validate(listings: DataFrame, profile: Profile = NEUTRAL) -> DataFrame:
    """Add the checked values; every input column stays.

    Pack size first, then the price derived from it, its band, and only then
    the alternative-price note; nutrition runs detect, bands, resolve, promote.
    All columns are narrow, so the same call works on a stream.
    """
    out = listings
    for columns in _passes(profile.key, profile.label, profile.price_band):
        out = out.withColumns(columns)
    return nutrition.validate(out, profile.nutrition_bands, profile.label).drop("_hints", "_bare")


@lru_cache(maxsize=None)
def _passes(key: str, label: str, band: tuple | None) -> list[dict[str, Column]]:
    """The projections of the pass, in order; built once per profile, since columns are immutable."""
    low, high = band or (None, None)
    return [
        {"size_label": variation.size_label(F.col("variation"), F.col("asin")),
         "_hints": quantity.listing_hints(), "_bare": quantity.listing_bare_weights(),
         "price_value": pricing.price(F.col("price")),
         "review_rating": reviews.rating(F.col("rating"), F.col("reviews.histogram_percent")),
         "review_negative_share": reviews.negative_share(F.col("rating"), F.col("reviews.histogram_percent")),
         "review_sample": reviews.sample(F.col("rating"), F.col("reviews")),
         "offer": variation.offer_key(F.col("variation"), F.col("asin")),
         "siblings": variation.siblings(F.col("variation")),
         "contract_version": lit(CONTRACT_VERSION), "category_profile": lit(key)},
        {"quantity": quantity.reconcile(F.col("package"), F.col("_hints"), F.col("_bare"))},
        {"price_per_base": pricing.per_base(F.col("price"), F.col("unit_price"), F.col("package"), F.col("quantity"))},
        {"price_per_base": pricing.within_band(F.col("price_per_base"), low, high, label)},
        {"price_per_base": pricing.with_alternative(
            F.col("price_per_base"), F.col("price"), quantity.consensus(F.col("_hints")))},
    ]


def serialise(validated: DataFrame, name: str = "json") -> DataFrame:
    """One JSON line per validated record: lineage and values, not the page text."""
    def text(c: str):
        return F.coalesce(F.col(c), lit("")).alias(c)

    return validated.select("asin", F.to_json(F.struct(
        "contract_version", "schema_version", "category_profile", text("asin"), text("title"),
        text("brand"), F.coalesce("product_url", lit("")).alias("url"), text("marketplace"),
        F.coalesce("search_query", lit("")).alias("query"), text("run_id"), text("locale"),
        "offer", "size_label", "siblings", "quantity", F.col("price_value").alias("price"),
        "price_per_base", F.map_from_entries(F.transform(
            F.array_sort("nutrition"), lambda e: F.struct(e["key"], e["v"]))).alias("nutrition"),
        "review_rating", "review_negative_share", "review_sample"),
        {"ignoreNullFields": "false"}).alias(name))
