"""Counters over listings: field coverage, sources, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfproof.functions.values import lit, unfold


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", lit(False))


def _some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, lit(False))


def checks() -> dict[str, Column]:
    """The 22 field checks, in order."""
    return {
        "title": _filled("title"), "brand": _filled("brand"),
        "price": F.col("price.amount").isNotNull(), "unit_price": F.col("unit_price.amount").isNotNull(),
        "rating": F.col("rating.value").isNotNull(), "rating_count": F.col("rating.count").isNotNull(),
        "feature_bullets": _some("content.feature_bullets"), "description": _filled("content.description"),
        "important_information": _some("content.important_information"), "aplus": _filled("content.aplus.text"),
        "ingredients": _filled("food.ingredients.text"), "allergens": _some("food.allergens"),
        "nutrition": _some("food.nutrition.per_100g"),
        "nutrition_protein": F.try_element_at(F.col("food.nutrition.per_100g"), lit("protein_g")).isNotNull(),
        "raw_tables": _some("raw_tables"),
        "country_of_origin": F.coalesce(F.try_element_at("attributes", lit("country_of_origin")) != "", lit(False)),
        "total_quantity": F.coalesce(F.col("package.total_quantity_base") != 0, lit(False)),
        "images": _some("media.images"), "breadcrumbs": _some("breadcrumbs"),
        "variation": _some("variation.values_by_asin"), "review_histogram": _some("reviews.histogram_percent"),
        "review_sample": _some("reviews.sample"),
    }


def coverage(df: DataFrame, tests: dict[str, Column] | None = None) -> DataFrame:
    """(field, filled, records): one aggregate row, unpivoted."""
    tests = tests or checks()
    counted = df.agg(F.count(lit(1)).alias("records"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(tests.values())])
    return counted.select("records", F.explode(F.array(*[F.struct(
        lit(k).alias("field"), F.col(f"c{i}").alias("filled")) for i, k in enumerate(tests)])).alias("f")) \
        .select("f.field", "f.filled", "records")


def source_counts(listings: DataFrame) -> DataFrame:
    """How often each block source and each block error occurs."""
    def of(kind: str, c: Column) -> Column:
        return F.when(F.coalesce(c != "", lit(False)), F.struct(lit(kind).alias("kind"), c.alias("name")))

    items = F.concat(F.array(of("nutrition", F.col("food.nutrition.source")),
                             of("ingredients", F.col("food.ingredients.source"))),
                     F.transform(F.coalesce(F.col("extraction.errors"), F.expr(
                         "cast(array() as array<struct<block: string, error: string>>)")),
                         lambda e: F.struct(lit("block error").alias("kind"), e["block"].alias("name"))))
    return unfold(listings, F.array_compact(items), "i").groupBy("i.kind", "i.name").agg(F.count(lit(1)).alias("n"))


def run_report(listings: DataFrame, unseen: DataFrame) -> DataFrame:
    """One row: pages read, records written, block errors, failed pages, pages no feed names."""
    totals = listings.agg(
        F.count(lit(1)).alias("pages"), F.count_if(F.col("page_error").isNull()).alias("records"),
        F.coalesce(F.sum(F.when(F.col("page_error").isNull(), F.size("extraction.errors"))), lit(0)).alias("block_errors"),
        F.count_if(F.col("page_error").isNotNull()).alias("failed"))
    both = totals.unionByName(unseen.agg(F.count(lit(1)).alias("unseen")), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("pages", "records", "block_errors", "failed", "unseen")])
