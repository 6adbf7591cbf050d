"""Explicit schemas.  A field missing from an old record reads as NULL, never as an error."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, DOUBLE, INT, LONG, BOOL = (T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def array(element: T.DataType) -> T.ArrayType:
    return T.ArrayType(element)


def mapping(value: T.DataType) -> T.MapType:
    return T.MapType(STRING, value)


NUTRITION = struct(
    source=STRING, basis_text=STRING, per_100g=mapping(DOUBLE),
    rows=array(struct(key=STRING, label=STRING, amount=DOUBLE, unit=STRING, value_text=STRING, basis_confirmed=BOOL)),
    derived=array(STRING))
REVIEWS = struct(
    histogram_percent=mapping(INT),
    sample=array(struct(
        id=STRING, rating=DOUBLE, rating_text=STRING, title=STRING, language=STRING, date=STRING, date_text=STRING,
        country=STRING, home_marketplace=BOOL, variant=STRING, verified=BOOL, helpful_votes=LONG, text=STRING)),
    sample_size=INT, sample_home=INT, rating_count=LONG, sample_source=STRING)
APLUS = struct(
    module_types=array(STRING), headings=array(STRING), text=STRING, text_length=INT,
    images=array(struct(url=STRING, alt=STRING)), tables=array(array(array(STRING))))
VARIATION = struct(
    dimensions=array(STRING), variation_values=mapping(array(STRING)), display_labels=mapping(STRING),
    values_by_asin=mapping(array(STRING)), current_asin=STRING, parent_asin=STRING, total_variations=INT)
PACKAGE = struct(
    item_weight_text=STRING, item_weight_amount=DOUBLE, item_weight_unit=STRING, item_weight_base=DOUBLE,
    package_weight_text=STRING, package_weight_amount=DOUBLE, package_weight_unit=STRING, package_weight_base=DOUBLE,
    unit_count_text=STRING, unit_count_amount=DOUBLE, unit_count_unit=STRING, unit_count_base=DOUBLE,
    volume_text=STRING, volume_amount=DOUBLE, volume_unit=STRING, volume_base=DOUBLE,
    item_count=INT, size_name=STRING, dimensions=STRING,
    total_quantity_base=DOUBLE, total_quantity_unit=STRING, total_quantity_source=STRING)

#: One extracted product record.
LISTING = struct(
    schema_version=INT, fetched_at=STRING, marketplace=STRING, asin=STRING, product_url=STRING, canonical_url=STRING,
    search_query=STRING, search_page=INT, search_position=INT, run_id=STRING, locale=STRING, accept_language=STRING,
    title=STRING, brand=STRING, byline_text=STRING, brand_url=STRING,
    price=struct(amount=DOUBLE, currency=STRING, text=STRING, range=array(DOUBLE)),
    unit_price=struct(amount=DOUBLE, unit=STRING, text=STRING),
    rating=struct(value=DOUBLE, count=LONG, text=STRING, count_text=STRING),
    availability=STRING, seller=STRING, breadcrumbs=array(STRING), package=PACKAGE,
    content=struct(feature_bullets=array(STRING), description=STRING,
                   important_information=array(struct(heading=STRING, text=STRING)), aplus=APLUS),
    food=struct(ingredients=struct(text=STRING, source=STRING), allergens=array(STRING), nutrition=NUTRITION),
    attributes=mapping(STRING), raw_tables=mapping(STRING), attribute_sources=mapping(STRING),
    media=struct(images=array(struct(url=STRING, variant=STRING, alt=STRING, thumb=STRING)),
                 primary_image=STRING, image_count=INT, image_source=STRING),
    variation=VARIATION, reviews=REVIEWS,
    extraction=struct(blocks_present=array(STRING), blocks_absent=array(STRING),
                      errors=array(struct(block=STRING, error=STRING))))

#: Provenance a retained page cannot know by itself.
CRAWL_FIELDS = ("marketplace", "asin", "product_url", "canonical_url", "search_query", "search_page",
                "search_position", "run_id", "locale", "accept_language", "fetched_at")

SIGHTING = struct(
    query=STRING, search_page=INT, position=INT, grid_position=INT, in_result_grid=BOOL, asin=STRING, sponsored=BOOL,
    sponsored_markers=array(STRING), result_title=STRING, result_price_text=STRING, result_price_amount=DOUBLE,
    product_url=STRING, run_id=STRING, marketplace=STRING, locale=STRING, seen_at=STRING)

RUN = struct(
    run_id=STRING, spider=STRING, marketplace=STRING, started_at=STRING, finished_at=STRING, finish_reason=STRING,
    pages_retained=BOOL, arguments=mapping(STRING),
    locale=struct(accept_language=STRING, language=STRING, expected_language=STRING, status=STRING),
    counts=mapping(LONG), stats=mapping(STRING))

PAGE = struct(asin=STRING, run_id=STRING, html=STRING, fetched_at=STRING)
