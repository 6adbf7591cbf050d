"""One row per offer, best first, with everything it leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.functions import values as V
from shelfproof.functions.values import filled, lit, nth, number_text
from shelfproof.operators import variation
from shelfproof.session import cut_lineage


def pack_size(size_label: Column, quantity: Column) -> Column:
    """The shop's own label, else the checked content in the larger unit when it fits."""
    unit = F.coalesce(filled(quantity["unit"]), lit("g"))
    big = F.when(unit == "g", lit("kg")).when(unit == "ml", lit("l"))
    amount = quantity["value"]
    return F.coalesce(filled(size_label), F.when(V.known(quantity), F.when(
        big.isNotNull() & (amount >= 1000), F.concat(number_text(amount / 1000), lit(" "), big))
        .otherwise(F.concat(number_text(amount), lit(" "), unit))), lit("?"))


def requiring(cards: DataFrame, claims) -> DataFrame:
    """Listings of which every named claim is trusted."""
    for key in claims:
        cards = cards.where(V.has_status(F.try_element_at("claims", lit(key)), V.TRUSTED))
    return cards


def matching(cards: DataFrame) -> DataFrame:
    """Listings their category accepted."""
    return cards.where(F.coalesce(F.col("category.text") == F.col("category_key"), lit(False)))


def place(cards: DataFrame, axis: str, better: str = "lower", order: str = "ord",
          keep: bool = True) -> DataFrame:
    """Cards with their offer, their value on the axis and whether it may be ranked.

    Only the columns a ranking shows are carried.  ``keep`` checkpoints this
    narrow table, because every part of a ranking reads it and the checks
    behind a card should run once.
    """
    narrow = cards.select(
        "asin", "brand", "title", "variation", F.col(order).alias("ord"),
        pack_size(F.col("size_label"), F.col("quantity")).alias("pack"),
        F.try_element_at("axes", lit(axis)).alias("v"))
    number = F.col("v.value")
    placed = (variation.with_offers(narrow).drop("variation")
              .withColumn("is_usable", V.usable(F.col("v")) & number.isNotNull())
              .withColumn("score", F.when(F.col("is_usable"), -number if better == "higher" else number)))
    return cut_lineage(placed) if keep else placed


def offers(placed: DataFrame) -> DataFrame:
    """One row per offer: its winning listing, how many it has, how many can be ranked.

    A single map-side combined aggregate, so an offer with very many listings
    reaches its reducer as one row per map task.
    """
    best = F.struct("ord", "score", "asin", "brand", "title", "pack",
                    F.col("v.value").alias("value"), F.col("v.unit").alias("unit"))
    return placed.groupBy("offer_id").agg(
        F.count(lit(1)).alias("listings"), F.count_if("is_usable").alias("rankable"),
        F.min_by(best, F.when(F.col("is_usable"), F.struct("score", "ord"))).alias("best"))


def _offer_tie() -> list[Column]:
    """Equal values: the offer with more listings first, then its key, then input order."""
    return [F.desc("listings"),
            F.when(F.col("offer_id").startswith("~"), lit("")).otherwise(F.col("offer_id")),
            F.col("ord")]


def top(placed: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` best offers with their position.

    Sorting and cutting is one distributed top-k; only the ``limit`` rows left
    are numbered.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    ranked = offers(placed).where("rankable > 0").select("offer_id", "listings", "rankable", "best.*")
    head = ranked.orderBy("score", *_offer_tie()).limit(limit)
    return head.withColumn("position", F.row_number().over(Window.orderBy("score", *_offer_tie())))


def rank(cards: DataFrame, axis: str, better: str = "lower", require=(), limit: int = 20,
         order: str = "ord", fold: bool = True, keep: bool = True) -> DataFrame:
    """The ranking: winners and, under each, the other packs of the same offer.

    ``fold`` adds the other packs.  They are found by joining the listings with
    the ``limit`` winning offers; Spark sizes that join.
    """
    placed = place(requiring(matching(cards), require), axis, better, order, keep and fold)
    winners = top(placed, limit)
    shown = ["position", "value", "unit", "brand", "title", "asin", "pack", "offer_id"]
    if not fold:
        return winners.select(*shown, "listings", (F.col("rankable") - 1).alias("folded"))
    heads = winners.select("offer_id", "position", F.col("ord").alias("_best"))
    return (placed.where("is_usable").join(heads, "offer_id")
            .withColumn("is_best", F.col("ord") == F.col("_best"))
            .withColumn("value", F.col("v.value")).withColumn("unit", F.col("v.unit"))
            .orderBy("position", F.desc("is_best"), "score", "ord").select(*shown, "is_best"))


def excluded(placed: DataFrame) -> DataFrame:
    """Every listing of an offer without a rankable value, with the reason."""
    out = placed.join(offers(placed).where("rankable = 0").select("offer_id", "listings"), "offer_id")
    reason = F.when(F.col("v").isNull(), lit("no value for this axis")).otherwise(
        F.coalesce(nth("v.notes", 0), F.col("v.status")))
    return out.select("asin", "offer_id", "listings", F.coalesce(
        F.col("v.status"), lit("absent")).alias("status"), reason.alias("reason"), "ord")


def excluded_head(placed: DataFrame, shown: int = 10) -> DataFrame:
    """The first excluded listings and how many there are in all."""
    out = excluded(placed)
    total = out.agg(F.count(lit(1)).alias("_total"))
    head = out.orderBy(*_offer_tie()).limit(shown).withColumn("_shown", lit(True))
    # At most ``shown`` rows and the one total, so the window is a handful of rows.
    both = head.unionByName(total, allowMissingColumns=True)
    return both.withColumn("excluded_total", F.max("_total").over(Window.partitionBy())) \
        .where("_shown").select("asin", "status", "reason", "excluded_total")


def numbered(df: DataFrame, keys: list[str], sort: list[str], name: str = "rank") -> DataFrame:
    """Exact ``row_number`` (BIGINT) per group, also when one group holds much of the data.

    Rows are range-partitioned by (keys, sort), kept in a reliable checkpoint so that both uses below see the same
    ranges, numbered within each range, and shifted by the rows of the same group in earlier ranges.  Only groups that cross
    a range border need a shift: at most two per range.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, *sort).withColumn("_range", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*sort)))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.sum("_n").over(earlier)).where("_shift IS NOT NULL").drop("_n").select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_in"), "_shift")
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return (local.join(shifts, same, "left")
            .withColumn(name, F.col("_local").cast("bigint") + F.coalesce("_shift", lit(0)))
            .drop("_range", "_local", "_shift", "_in", *[f"_of_{k}" for k in keys]))
