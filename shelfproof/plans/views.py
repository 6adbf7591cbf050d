"""Driver tables seen as the tables the jobs work on.

Each view is a projection (or one aggregate) of a whole driver table; no rows
are left out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfproof.functions.values import lit
from shelfproof.schema import LISTING
from shelfproof.session import shared_folder


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a small file would otherwise be one task.

    The rules cost far more than reading a row, so a table that arrives in
    fewer pieces than there are cores is dealt out once.  A large table already
    has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output, in the shared folder the cluster names."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(6).hex()}"


def listing(df: DataFrame, **columns: Column) -> DataFrame:
    """A listing with the given columns; every other field is NULL, as in an old record."""
    ready = df.withColumns({f"_in_{k}": c for k, c in columns.items()})
    out = [F.col(f"_in_{f.name}").cast(f.dataType).alias(f.name) if f.name in columns
           else lit(None).cast(f.dataType).alias(f.name) for f in LISTING.fields]
    return ready.select(*out, *( [F.col("_in_ord").alias("ord")] if "ord" in columns else []))


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else lit(str(p)) for p in parts])


def shape(struct: str, **fields: Column) -> Column:
    """A struct of a listing field, missing members NULL."""
    dtype = LISTING[struct].dataType
    return F.struct(*[(fields[f.name] if f.name in fields else lit(None)).cast(f.dataType).alias(f.name)
                      for f in dtype.fields])


def brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")


def shelf(spark: SparkSession, sf: str) -> DataFrame:
    return shelf_of(spread(table(spark, sf, "part")))


def shelf_of(part: DataFrame) -> DataFrame:
    """``part`` as a shelf of listings.

    The type of a part decides how its title and its filed total relate:
    confirmed by a count, within tolerance, disputed, silent, confirmed by a
    bare weight, contradicted by its package.  The brand decides what unit
    price is published.  A brand and a type make one offer, the size its pack.
    """
    size, kind = F.col("p_size"), F.col("p_type")
    title = (F.when(kind == "ECONOMY", text(F.col("p_name"), " ", size, " x 100 g"))
             .when(kind == "PROMO", text(F.col("p_name"), " 100 g (", size, "er Pack)"))
             .when(kind == "STANDARD", text(F.col("p_name"), " ", size, " Packungen mit 100 g"))
             .when(kind == "SMALL", text(F.col("p_name"), " ", size * 100, " g"))
             .otherwise(F.col("p_name")))
    total = (F.when(kind == "PROMO", size * 110.0).when(kind == "STANDARD", size * 300.0).otherwise(size * 100.0))
    heavy = ~kind.isin("ECONOMY", "PROMO", "STANDARD", "SMALL", "MEDIUM")
    number = brand_number()
    per_kg = F.col("p_retailprice") / (size * 100.0 / 1000.0)
    return listing(
        part, ord=F.col("p_partkey"), asin=F.col("p_partkey").cast("string"), title=title,
        brand=F.col("p_brand"), marketplace=lit("amazon.de"),
        breadcrumbs=F.array(lit("shelf"), kind),
        price=shape("price", amount=F.when(kind != "MEDIUM", F.col("p_retailprice")), currency=lit("EUR"),
                    text=F.format_string("%.2f EUR", F.col("p_retailprice")),
                    range=F.when(kind == "MEDIUM", F.array(F.col("p_retailprice"), F.col("p_retailprice") * 2))),
        unit_price=shape("unit_price",
                         amount=F.when(number <= 8, per_kg).when(number <= 16, per_kg * 2)
                         .when(number <= 20, per_kg / 10),
                         unit=F.when(number <= 16, lit("kg")).when(number <= 20, lit("100 g"))),
        package=shape("package", total_quantity_base=total, total_quantity_unit=lit("g"),
                      total_quantity_source=F.when(heavy, lit("item_weight")).otherwise(lit("unit_count")),
                      item_weight_base=F.when(heavy, total * 2), package_weight_base=F.when(heavy, total)),
        variation=shape("variation", dimensions=F.array(lit("flavor_name")),
                        values_by_asin=F.create_map(F.col("p_partkey").cast("string"), F.array(kind)),
                        parent_asin=F.col("p_brand")))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as captures of products from several feeds; error events carry no stamp.

    A user is a product, the event id the order of reading; signups have no id.
    """
    return table(spark, sf, "events").select(
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("asin"),
        F.when(F.col("event_type") != "error", F.col("ts").cast("string")).alias("fetched_at"),
        "event_id", "event_type", "value", F.col("event_id").alias("ord"))


def sighting_log(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a sighting log: a day is a run, the event type a query."""
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("query"),
        F.col("user_id").alias("asin"), "event_id", "ts", "value", (F.col("value") > 40).alias("sponsored"))


def text_fields(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as vendor text: the first line is the title, each other line a bullet."""
    return (spread(table(spark, sf, "documents"))
            .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
            .withColumn("field", F.when(F.col("ord") == 0, lit("title")).otherwise(
                text("content.feature_bullets[", F.col("ord") - 1, "]"))))


def star_counts(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as ratings: per part, how many at each of five levels (line numbers 1-5, later ones count as 5)."""
    level = F.least("l_linenumber", lit(5))
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("asin")).agg(
        F.count(lit(1)).alias("n"), *[F.count_if(level == i).alias(f"c{i}") for i in range(1, 6)],
        F.sum(level).alias("stars"), F.max("l_returnflag").alias("flag"))


NUTRIENT_LINES = {1: "protein_g", 2: "carbohydrates_g", 3: "fat_g", 4: "energy_kcal", 5: "salt_g"}


def nutrient_table(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as a long nutrient table: one amount per part and line number.

    Energy is ten times the quantity; a line with an ``R`` flag is filed in the
    wrong unit.
    """
    key = F.element_at(F.create_map(*[x for i, k in NUTRIENT_LINES.items() for x in (lit(i), lit(k))]),
                       F.least("l_linenumber", lit(5)))
    per = table(spark, sf, "lineitem").withColumn("key", key).groupBy(
        F.col("l_partkey").alias("asin"), "key").agg(
            F.when(F.col("key") == "fat_g", F.min("l_quantity")).otherwise(F.max("l_quantity")).alias("q"),
            F.min("l_returnflag").alias("flag"))
    return per.select(
        "asin", "key", F.when(F.col("key") == "energy_kcal", F.col("q") * 10).otherwise(F.col("q")).alias("amount"),
        F.when((F.col("flag") == "R"), lit("stück")).when(F.col("key") == "energy_kcal", lit("kcal"))
        .otherwise(lit("g")).alias("unit"),
        lit("structured").alias("source"), lit(False).alias("derived"), lit(True).alias("basis_confirmed"))
