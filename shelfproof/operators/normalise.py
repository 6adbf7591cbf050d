"""Raw rows to typed rows: the text rules of a locale as whole-table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfproof.functions import labels as LB
from shelfproof.functions.text import clean, number, quantity
from shelfproof.functions.values import lit


def attributes(raw: DataFrame, language: str = "de", decimal: str = ",") -> DataFrame:
    """(asin, ord, label, value) -> + canonical key, amount, unit, base, heading flag."""
    out = raw.withColumn("value", clean(F.col("value"))).withColumn("_q", quantity(F.col("value"), decimal))
    return out.withColumns({
        "canonical_key": LB.attribute_key(F.col("label"), language),
        "amount": F.col("_q.amount"), "unit": F.col("_q.unit"), "base": F.col("_q.base"),
        "ingredient_heading": LB.is_ingredient_heading(F.col("label"), language)}).drop("_q")


def first_per_key(rows: DataFrame, keys=("asin", "canonical_key"), order: str = "ord") -> DataFrame:
    """The first row of every key, as one map-side combined aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def nutrients(raw: DataFrame, language: str = "de", decimal: str = ",") -> DataFrame:
    """(asin, label, value_text) -> + nutrient key, amount, unit, stored key."""
    out = raw.withColumns({
        "key": LB.nutrient_key(F.col("label"), language),
        "amount": number(F.col("value_text"), decimal), "unit": LB.nutrient_unit(F.col("value_text"))})
    return out.withColumn("stored_as", F.when((F.col("key") == "energy_kj") & (F.col("unit") == "kcal"),
                                              lit("energy_kcal")).otherwise(F.col("key")))


def reviews(raw: DataFrame, language: str = "de", home: str = "deutschland") -> DataFrame:
    """Raw cards (dateline, badge, votes_text, bar_label, body) -> typed columns."""
    line = LB.dateline(F.col("dateline"), language, home)
    bar = LB.histogram_share(F.col("bar_label"), language)
    return raw.withColumns({
        "country": line["country"], "date": line["date"], "home_marketplace": line["home"],
        "verified": LB.is_verified(F.col("badge"), language),
        "helpful_votes": LB.helpful_votes(F.col("votes_text"), language),
        "stars": bar["stars"], "percent": bar["percent"],
        "text": LB.without_noise(F.col("body"), language)})
