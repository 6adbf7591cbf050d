"""Product families: which listings are one product in different packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfproof.functions.text import matches
from shelfproof.functions.values import filled, let, lit, nth

# Dimensions that state a pack size, and a pack size leaking
# into the end of another dimension.
SIZE_DIMENSIONS = ("size_name", "size")
PACK_SUFFIX = (r"(?iU)[,;]?\s*\(?\s*\d{1,3}\s*[x×]\s*\d[\d.,]*\s*"
               r"(?:g|gr|gramm|kg|ml|l)\b\s*\)?\s*$")


def has_matrix(variation: Column) -> Column:
    return F.coalesce(F.size(variation["values_by_asin"]) > 0, lit(False))


def _values(variation: Column, asin: Column) -> Column:
    """The member's values, or NULL when they do not line up with the dimensions."""
    values = F.try_element_at(variation["values_by_asin"], asin)
    return F.when(F.size(values) == F.size(variation["dimensions"]), values)


def size_label(variation: Column, asin: Column) -> Column:
    """The pack-size label of one member, ``''`` when no dimension states one."""
    sizes = F.filter(F.arrays_zip(variation["dimensions"].alias("dimension"),
                                  _values(variation, asin).alias("value")),
                     lambda d: d["dimension"].isin(*SIZE_DIMENSIONS))
    return F.coalesce(nth(sizes, 0)["value"], lit(""))


def siblings(variation: Column) -> Column:
    """Every member of the family, sorted."""
    return F.coalesce(F.sort_array(F.map_keys(variation["values_by_asin"])),
                      F.array().cast("array<string>"))


def family(variation: Column) -> Column:
    """The family's parent id, else its member set; NULL for a lone member."""
    members = siblings(variation)
    return F.when(has_matrix(variation), F.coalesce(
        filled(variation["parent_asin"]),
        F.when(F.size(members) > 1, F.concat(lit("set:"), F.array_join(members, ",")))))


def signature(variation: Column, asin: Column) -> Column:
    """What tells a member from its siblings apart from the pack size."""
    return _signature(variation["dimensions"], F.try_element_at(variation["values_by_asin"], asin))


def _signature(dimensions: Column, values: Column) -> Column:
    """The signature of a member with these values; empty when they do not line up with the dimensions."""
    pairs = F.arrays_zip(dimensions.alias("dimension"), values.alias("value"))
    other = F.filter(pairs, lambda d: ~d["dimension"].isin(*SIZE_DIMENSIONS))
    folded = F.transform(other, lambda d: F.replace(
        F.lower(F.trim(F.regexp_replace(d["value"], PACK_SUFFIX, ""))), lit("ß"), lit("ss")))
    return F.when(F.size(values) == F.size(dimensions), folded).otherwise(F.array().cast("array<string>"))


def offer_key(variation: Column, asin: Column) -> Column:
    """``STRUCT<family, signature>``: this product in whatever pack; NULL if it has no family."""
    return F.when(family(variation).isNotNull(), F.struct(
        family(variation).alias("family"), signature(variation, asin).alias("signature")))


def poolable() -> Column:
    """Whether a record shows a matrix that says which offer its members belong to."""
    return F.coalesce(has_matrix(F.col("variation")) & family(F.col("variation")).isNotNull(), lit(False))


def matrix_digest() -> Column:
    return F.sha2(F.to_json("variation"), 256)


def member_offers(matrix: Column) -> Column:
    """``member`` and ``offer`` of every entry of a matrix, whose family is worked out once."""
    entries = F.map_entries(matrix["values_by_asin"])
    return let(F.struct(family(matrix).alias("family"), matrix["dimensions"].alias("dimensions")),
               lambda m: F.transform(entries, lambda e: F.struct(e["key"].alias("member"), F.to_json(F.struct(
                   m["family"].alias("family"), _signature(m["dimensions"], e["value"]).alias("signature"))).alias("offer"))))


def own_offer(order: str = "ord") -> Column:
    """``STRUCT<member, offer>`` of a record by itself; one without an id is a member of its own."""
    asin = filled(F.col("asin"))
    alone = F.concat(lit("~"), F.coalesce(asin, lit("")), lit("#"), F.col(order).cast("string"))
    return F.struct(F.coalesce(asin, alone).alias("member"), F.coalesce(
        F.to_json(offer_key(F.col("variation"), F.col("asin"))), alone).alias("offer"))


def offer_index(records: DataFrame, order: str = "ord") -> DataFrame:
    """``asin -> offer`` pooled from every matrix; the first record to claim an id wins.

    Records that show the same matrix count once, by its digest.  Each of a matrix's entries gives a row of member and
    offer, so the matrix itself is not repeated and the work is linear in
    its members.  A map-side combined ``min_by`` per id follows.
    """
    shown = (records.where(poolable()).select("variation", F.col(order).alias("_claim"))
             .groupBy(matrix_digest().alias("_digest"))
             .agg(F.min("_claim").alias("_claim"), F.first("variation").alias("variation")))
    claims = shown.select("_claim", F.explode(member_offers(F.col("variation"))).alias("_o")).select("_claim", "_o.member", "_o.offer")
    return claims.groupBy("member").agg(F.min_by("offer", F.struct("_claim", "offer")).alias("offer"))


def with_offers(records: DataFrame, order: str = "ord") -> DataFrame:
    """Add ``offer_id``: the pooled key, else the record's own, else the record alone.

    Records without an id get a key of their own before the join, so they do
    not all hash to one task.
    """
    index = offer_index(records, order).withColumnRenamed("offer", "_pooled")
    return (records.withColumn("_own", own_offer(order))
            .join(index, F.col("_own.member") == F.col("member"), "left")
            .withColumn("offer_id", F.coalesce("_pooled", "_own.offer"))
            .drop("_own", "member", "_pooled"))


def offer_sizes(placed: DataFrame) -> DataFrame:
    """Offers with their number of listings, the biggest first."""
    return placed.groupBy("offer_id").agg(F.count(lit(1)).alias("listings")) \
                 .orderBy(F.desc("listings"), "offer_id")
