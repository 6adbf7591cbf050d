"""Nutrition declarations checked without knowing the food.

Two forms of the same rules.  ``validate`` works on the nested block of one
listing and needs no shuffle.  ``validate_long`` works on a long nutrient
table, where one pre-aggregated pass per listing gives the facts the rules ask.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.functions import values as V
from shelfproof.functions.text import matches
from shelfproof.functions.values import cases, let, lit, nth, number_text
from shelfproof.operators.pricing import within_band
from shelfproof.operators.quantity import gap

# Energy per gram, tolerances, units a key may be measured in.
KCAL_PER_G = {"protein_g": 4.0, "carbohydrates_g": 4.0, "fat_g": 9.0}
MACROS = ("protein_g", "carbohydrates_g", "fat_g")
ENERGY_TOLERANCE = 0.35
MASS_LIMIT = 105.0
FIELD_UNITS = {
    "energy_kcal": ("kcal",), "energy_kj": ("kj",), "sodium_mg": ("mg", "g"),
    "protein_g": ("g", "mg"), "carbohydrates_g": ("g", "mg"), "fat_g": ("g", "mg"),
    "saturated_fat_g": ("g", "mg"), "sugars_g": ("g", "mg"), "fiber_g": ("g", "mg"),
    "salt_g": ("g", "mg"),
}
BLOCK_SOURCES = {"nutrition_card": V.STRUCTURED, "attributes": V.ATTRIBUTES}
BASIS_PHRASE = r"(?iU)(?:pro|per|/)\s*100\s*(?:g|ml|gramm)\b"

UNCONFIRMED_BASIS = "unconfirmed_basis"
CONTRADICTION = "energy_macro_contradiction"
UNCORROBORATED = "uncorroborated"
BLOCKING = (UNCONFIRMED_BASIS, CONTRADICTION, UNCORROBORATED)

NUTRIENTS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()),
                                      T.StructField("v", V.VALUE)]))


def block_source(source: Column) -> Column:
    return cases(*[(source == k, lit(v)) for k, v in BLOCK_SOURCES.items()],
                 otherwise=lit(V.TEXT))


def key_unit(key: Column) -> Column:
    return cases((key == "energy_kcal", lit("kcal")), (key == "energy_kj", lit("kJ")),
                 (key.endswith("_mg"), lit("mg")), otherwise=lit("g"))


def rejection(key: Column, row: Column) -> Column:
    """Why a row cannot be this nutrient at all, NULL when it can."""
    unit = F.lower(F.coalesce(row["unit"], lit("")))
    wrong_unit = reduce(lambda acc, kv: acc | ((key == kv[0]) & ~unit.isin(*kv[1])),
                        FIELD_UNITS.items(), lit(False))
    text = F.coalesce(row["value_text"], lit(""))
    numbers = F.array_distinct(F.regexp_extract_all(text, lit(r"\d[\d.,]*"), lit(0)))
    basis_number = matches(text, BASIS_PHRASE) & (row["amount"] == 100) & (F.size(numbers) <= 1)
    return cases(
        (F.coalesce((unit != "") & wrong_unit, lit(False)), F.concat(
            lit("unit "), unit, lit(" does not measure "), key)),
        (F.coalesce(basis_number, lit(False)), lit("the number is part of the basis phrase")),
        otherwise=lit(None).cast("string"))


def _values(nutrition: Column) -> Column:
    """One value per declared nutrient, rejected or flagged on its own row alone."""
    source = block_source(nutrition["source"])

    def one(e: Column) -> Column:
        key = e["key"]
        row = nth(F.filter(nutrition["rows"], lambda r: r["key"] == key), 0)
        words = F.coalesce(row["value_text"], lit(""))
        proof = [V.evidence(F.concat(lit("food.nutrition["), key, lit("]")), F.when(
            words != "", F.concat(F.coalesce(row["label"], key), lit(": "), words))
            .otherwise(e["value"].cast("string")))]
        derived = F.coalesce(F.array_contains(nutrition["derived"], key), lit(False))
        loose = (source == V.TEXT) & ~F.coalesce(row["basis_confirmed"], lit(False))
        reason = rejection(key, row)
        kept = V.value(
            e["value"], status=V.UNVERIFIED, unit=key_unit(key), evidence=proof,
            source=F.when(derived, V.DERIVED).otherwise(source),
            notes=F.array_compact(F.array(
                F.when(derived, lit("derived, not published by the vendor")),
                F.when(loose, lit("from prose that states no per-100 g basis")))),
            flags=F.array_compact(F.array(F.when(loose, lit(UNCONFIRMED_BASIS)))))
        return F.struct(key.alias("key"), F.when(reason.isNotNull(), V.value(
            None, unit=key_unit(key), evidence=proof, source=source,
            notes=F.array(reason))).otherwise(kept).alias("v"))

    entries = F.map_entries(nutrition["per_100g"])
    return F.coalesce(F.transform(entries, one), F.array()).cast(NUTRIENTS)


def _each(values: Column, when, change) -> Column:
    """Apply ``change`` to the values for which ``when(key, v)`` holds."""
    return F.transform(values, lambda e: F.struct(
        e["key"].alias("key"), F.when(when(e["key"], e["v"]), change(e["v"])).otherwise(e["v"]).alias("v")))


def _is_macro(key: Column) -> Column:
    return key.isin(*MACROS)


def _total(values: Column, weight) -> Column:
    return F.aggregate(
        F.filter(values, lambda e: _is_macro(e["key"]) & V.known(e["v"])), lit(0.0),
        lambda acc, e: acc + e["v"]["value"] * weight(e["key"]))


def _energy_factor(key: Column) -> Column:
    return cases(*[(key == k, lit(f)) for k, f in KCAL_PER_G.items()], otherwise=lit(0.0))


def mass_balance(values: Column) -> Column:
    """Dispute protein, carbohydrate and fat that outweigh the 100 g they sit in."""
    return let(values, lambda vs: let(_total(vs, lambda k: lit(1.0)), lambda total: F.when(
        total > MASS_LIMIT, _each(vs, lambda k, v: _is_macro(k) & V.known(v), lambda v: V.disputed(
            v, F.concat(lit("the macronutrients add up to "), F.round(total, 0).cast("bigint").cast("string"),
                        lit(" g per 100 g"))))).otherwise(vs)))


def energy_balance(values: Column) -> Column:
    """Flag energy and macronutrients that contradict each other."""
    def check(vs: Column) -> Column:
        energy = F.get(F.filter(vs, lambda e: (e["key"] == "energy_kcal") & V.known(e["v"])),
                       lit(0))["v"]["value"]

        def flag(implied: Column) -> Column:
            off = F.coalesce((implied != 0) & (gap(implied, energy) > ENERGY_TOLERANCE), lit(False))
            note = F.concat(lit("energy and macronutrients contradict each other: "),
                            number_text(energy), lit(" against "), number_text(F.round(implied, 0)),
                            lit(" kcal"))
            return F.when(off, _each(
                vs, lambda k, v: ((k == "energy_kcal") | _is_macro(k)) & V.known(v),
                lambda v: V.flagged(v, CONTRADICTION, note))).otherwise(vs)

        return let(_total(vs, _energy_factor), flag)

    return let(values, check)


def corroboration(values: Column) -> Column:
    """Flag the only known nutrient of a block; the kJ twin of kcal does not count."""
    def counts(key: Column, v: Column) -> Column:
        return (key != "energy_kj") & V.known(v)

    return let(values, lambda vs: F.when(
        F.size(F.filter(vs, lambda e: counts(e["key"], e["v"]))) < 2,
        _each(vs, counts, lambda v: V.flagged(
            v, UNCORROBORATED, "the only nutrient stated, so nothing can confirm it"))).otherwise(vs))


def bands(values: Column, limits: dict[str, tuple[float, float]], label: str) -> Column:
    """Dispute values outside the range of the category."""
    if not limits:
        return values

    def bound(key: Column, i: int) -> Column:
        return cases(*[(key == k, lit(float(b[i]))) for k, b in limits.items()],
                     otherwise=lit(None).cast("double"))

    def one(e: Column) -> Column:
        low, high, v = bound(e["key"], 0), bound(e["key"], 1), e["v"]
        outside = V.known(v) & F.coalesce((v["value"] < low) | (v["value"] > high), lit(False))
        return F.struct(e["key"].alias("key"), F.when(outside, V.disputed(v, F.concat(
            number_text(v["value"]), lit(" "), v["unit"], lit(" per 100 g is outside the "),
            number_text(low), lit("-"), number_text(high), lit(f" range of {label}"))))
            .otherwise(v).alias("v"))

    return F.transform(values, one)


def resolve(values: Column) -> Column:
    """A contradiction with one disputed side is explained by it; the others are released."""
    def involved(v: Column) -> Column:
        return F.array_contains(v["flags"], CONTRADICTION)

    return let(values, lambda vs: F.when(
        F.exists(vs, lambda e: involved(e["v"]) & V.has_status(e["v"], V.DISPUTED)),
        _each(vs, lambda k, v: involved(v) & ~V.has_status(v, V.DISPUTED), lambda v: V.updated(
            v, flags=lambda x: F.array_remove(x["flags"], CONTRADICTION),
            notes=lambda x: V.plus(x["notes"], "the disputed value explains the contradiction")))).otherwise(vs))


def promote(values: Column) -> Column:
    """Trust what was never flagged, never disputed and not derived."""
    blocked = F.array(*[lit(b) for b in BLOCKING])
    return _each(values, lambda k, v: V.has_status(v, V.UNVERIFIED) & V.known(v)
                 & (v["source"] != V.DERIVED) & ~F.arrays_overlap(v["flags"], blocked), V.trusted)


def detect(nutrition: Column) -> Column:
    """Values of one block after every rule that needs no category."""
    return corroboration(energy_balance(mass_balance(_values(nutrition))))


def validate(df: DataFrame, limits: dict | None = None, label: str = "product",
             block: str = "food.nutrition", name: str = "nutrition") -> DataFrame:
    """Add the checked values of each listing: detect, bands, resolve, promote, in this order.

    Each pass is its own projection, so no pass is evaluated twice.
    """
    out = df
    for step in _passes(tuple((limits or {}).items()), label, block, name):
        out = out.withColumn(name, step)
    return out


@lru_cache(maxsize=None)
def _passes(limits: tuple, label: str, block: str, name: str) -> list[Column]:
    values = F.col(name)
    return [_values(F.col(block)), mass_balance(values), energy_balance(values), corroboration(values),
            *([bands(values, dict(limits), label)] if limits else []), resolve(values), promote(values)]


def of(values: Column, key: str) -> Column:
    """One nutrient's value struct, NULL when the block does not state it."""
    return nth(F.filter(values, lambda e: e["key"] == key), 0)["v"]


def validate_long(nutrients: DataFrame, keys=("asin",), limits: dict | None = None) -> DataFrame:
    """The same rules over a long table (keys, key, amount, unit, source, derived, basis_confirmed).

    The facts the rules need per listing are windows over the listing key, so rows move once.
    ``limits`` gives (low, high) by nutrient; a nutrient outside the known ones is read as stated.
    """
    keys = list(keys)
    macro = F.col("key").isin(*MACROS)
    allowed = reduce(lambda acc, kv: acc | ((F.col("key") == kv[0]) & F.lower("unit").isin(*kv[1])),
                     FIELD_UNITS.items(), ~F.col("key").isin(*FIELD_UNITS))
    rows = nutrients.withColumn("known", F.coalesce(
        (F.coalesce(F.col("unit"), lit("")) == "") | allowed, lit(False)) & F.col("amount").isNotNull())
    band = lambda i: cases(*[(F.col("key") == k, lit(float(b[i]))) for k, b in (limits or {}).items()],
                           otherwise=lit(None).cast("double"))
    rows = rows.withColumns({"low": band(0), "high": band(1)})
    rows = rows.withColumn("out_of_band", F.coalesce(
        (F.col("amount") < F.col("low")) | (F.col("amount") > F.col("high")), lit(False)) & F.col("known"))
    listing = Window.partitionBy(*keys)
    joined = rows.withColumns({
        "mass": F.sum(F.when(macro & F.col("known"), F.col("amount")).otherwise(0.0)).over(listing),
        "implied": F.sum(F.when(macro & F.col("known"), F.col("amount") * _energy_factor(F.col("key")))
                         .otherwise(0.0)).over(listing),
        "energy": F.max(F.when((F.col("key") == "energy_kcal") & F.col("known"), F.col("amount"))).over(listing),
        "checkable": F.sum(F.when((F.col("key") != "energy_kj") & F.col("known"), 1).otherwise(0)).over(listing),
        "band_hit": F.coalesce(F.max(F.col("out_of_band") & (macro | (F.col("key") == "energy_kcal"))).over(listing),
                               lit(False))})
    heavy = F.col("mass") > MASS_LIMIT
    clash = F.coalesce((F.col("implied") != 0)
                       & (gap(F.col("implied"), F.col("energy")) > ENERGY_TOLERANCE), lit(False))
    in_clash = clash & (macro | (F.col("key") == "energy_kcal")) & F.col("known")
    explained = F.col("band_hit") | (heavy & (F.col("mass") > 0))
    lone = (F.col("checkable") < 2) & (F.col("key") != "energy_kj") & F.col("known")
    loose = (F.col("source") == V.TEXT) & ~F.coalesce(F.col("basis_confirmed"), lit(False))
    return joined.withColumn("status", cases(
        (~F.col("known"), lit(V.UNKNOWN)),
        (F.col("out_of_band") | (heavy & macro), lit(V.DISPUTED)),
        ((in_clash & ~explained) | lone | loose | F.coalesce(F.col("derived"), lit(False)),
         lit(V.UNVERIFIED)),
        otherwise=lit(V.TRUSTED))).select(
            *keys, "key", "amount", "unit", "status",
            F.round("mass", 4).alias("mass"), F.round("implied", 4).alias("implied"), "checkable")
