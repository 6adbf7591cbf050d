"""What a listing costs, and what it costs per kilogram or litre."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.functions import values as V
from shelfproof.functions.text import lookup, squeeze
from shelfproof.functions.values import cases, filled, let, lit, nth, number_text
from shelfproof.operators.quantity import gap

# Tolerance, and how a published per-unit price converts.
TOLERANCE = 0.12
BASE_UNIT = {"g": "kg", "ml": "l"}
DIVISOR = 1000.0
PUBLISHED_UNITS = {
    "kg": ("kg", 1.0), "kilogramm": ("kg", 1.0), "kilogram": ("kg", 1.0),
    "g": ("kg", 1000.0), "gramm": ("kg", 1000.0), "gram": ("kg", 1000.0),
    "100 g": ("kg", 10.0), "100 gramm": ("kg", 10.0), "100 gram": ("kg", 10.0),
    "l": ("l", 1.0), "liter": ("l", 1.0), "litre": ("l", 1.0),
    "ml": ("l", 1000.0), "milliliter": ("l", 1000.0),
    "100 ml": ("l", 10.0), "100 milliliter": ("l", 10.0),
}
COUNT_UNITS = ("stück", "stueck", "stk", "st", "einheit", "count", "piece", "item", "blatt",
               "sheet", "waschgang", "stk.")


def published(unit_price: Column, base_unit: Column) -> Column:
    """``STRUCT<amount, note>``: the published figure per base unit, or why it is no use."""
    unit = squeeze(F.trim(F.lower(F.coalesce(unit_price["unit"], lit("")))))

    def read(u: Column) -> Column:
        dimension = lookup({k: v[0] for k, v in PUBLISHED_UNITS.items()}, u)
        factor = lookup({k: v[1] for k, v in PUBLISHED_UNITS.items()}, u)
        counts = lit(False)
        for word in COUNT_UNITS:
            counts = counts | u.startswith(word)
        same = F.coalesce(dimension == base_unit, lit(False))
        amount = F.when(same, unit_price["amount"] * factor)
        note = cases(
            (unit_price["amount"].isNull() | base_unit.isNull() | (u == "") | same, lit(None)),
            (dimension.isNotNull(), F.concat(lit("published per "), u, lit(
                " for a pack of the other dimension; a density is missing"))),
            (counts, F.concat(lit("published per "), u, lit(
                ", which counts pieces and says nothing about content"))),
            otherwise=F.concat(lit("published per "), u, lit(
                ", for which no conversion is known")))
        return F.struct(amount.alias("amount"), note.cast("string").alias("note"))

    return let(unit, read)


def price(p: Column) -> Column:
    """The price as a value: trusted when stated, unknown for a range or none."""
    amount, currency = p["amount"], F.coalesce(p["currency"], lit(""))
    low, high = nth(p["range"], 0), F.element_at(p["range"], -1)
    shown = F.coalesce(filled(p["text"]), F.concat(number_text(amount), lit(" "), currency))
    span = F.coalesce(filled(p["text"]), F.concat(
        number_text(low), lit(" - "), number_text(high), lit(" "), currency))
    return cases(
        (amount.isNotNull(), V.value(amount, status=V.TRUSTED, unit=currency, source=V.PUBLISHED,
                                     evidence=[V.evidence("price", shown)])),
        (F.coalesce(F.size(p["range"]) > 0, lit(False)), V.value(
            None, evidence=[V.evidence("price.range", span)],
            notes=["a price range is shown; neither end is the price of this listing"])),
        otherwise=V.unknown("no price was published"))


def per_base(p: Column, unit_price: Column, package: Column, quantity: Column) -> Column:
    """Price per kilogram or litre, following the pack's own unit.

    A disputed pack size disputes it; a confirmed pack size beats a published
    figure that disagrees; otherwise disagreement disputes and agreement
    confirms.
    """
    amount, currency = p["amount"], F.coalesce(p["currency"], lit(""))
    pack_unit = F.when(V.known(quantity), quantity["unit"]).otherwise(package["total_quantity_unit"])
    base_unit = lookup(BASE_UNIT, F.coalesce(pack_unit, lit("")))
    inputs = F.struct(
        F.when((amount != 0) & V.known(quantity) & (quantity["value"] != 0) & base_unit.isNotNull(),
               amount / (quantity["value"] / DIVISOR)).alias("derived"),
        published(unit_price, base_unit).alias("published"))

    def build(i: Column) -> Column:
        derived, stated, note = i["derived"], i["published"]["amount"], i["published"]["note"]
        unit = F.concat(currency, lit("/"), F.coalesce(base_unit, lit("")))
        proof = F.array_compact(F.array(
            F.when(stated.isNotNull(), V.evidence("unit_price", F.coalesce(
                filled(unit_price["text"]), F.concat(number_text(stated), lit(" "), unit)))),
            F.when(derived.isNotNull(), V.evidence("price ÷ package.total_quantity_base", F.concat(
                number_text(amount), lit(" "), currency, lit(" ÷ "),
                number_text(quantity["value"]), lit(" "), pack_unit)))))
        base = V.value(F.round(F.coalesce(derived, stated), 2), status=V.UNVERIFIED, unit=unit,
                       source=F.when(derived.isNotNull(), V.DERIVED).otherwise(V.PUBLISHED),
                       evidence=proof, notes=F.array_compact(F.array(note)))
        both = derived.isNotNull() & stated.isNotNull()
        apart = both & (gap(stated, derived) > TOLERANCE)
        sure = V.has_status(quantity, V.TRUSTED)

        def decide(v: Column) -> Column:
            return cases(
                (V.has_status(quantity, V.DISPUTED), V.disputed(
                    v, "derived from a pack size that the page contradicts",
                    F.slice(quantity["evidence"], lit(2), F.size(quantity["evidence"])))),
                (apart & sure, V.trusted(v, F.concat(
                    lit("the published "), number_text(stated), lit(" "), unit,
                    lit(" does not fit the confirmed pack size")))),
                (apart, V.disputed(v, F.concat(
                    lit("the published "), number_text(stated), lit(" and the derived "),
                    number_text(F.round(derived, 2)), lit(" disagree")))),
                (both, V.trusted(v, "agrees with the published figure")),
                (sure, V.trusted(v)),
                (stated.isNotNull(), V.noted(v, "published, with no pack size to check it against")),
                otherwise=v)

        return F.when(F.coalesce(derived, stated).isNotNull(), let(base, decide)).otherwise(
            V.unknown(F.coalesce(note, lit("no unit price, and none derivable"))))

    return let(inputs, build)


def within_band(v: Column, low, high, label) -> Column:
    """Dispute a known value outside the range its category sells in; NULL bounds ask nothing."""
    low, high = V.col(low).cast("double"), V.col(high).cast("double")
    outside = F.coalesce((v["value"] < low) | (v["value"] > high), lit(False))
    return F.when(V.known(v) & ~V.has_status(v, V.DISPUTED) & outside, V.disputed(v, F.concat(
        number_text(v["value"]), lit(" "), v["unit"], lit(" is outside the "), number_text(low),
        lit("-"), number_text(high), lit(" range of "), V.col(label)))).otherwise(v)


def with_alternative(v: Column, p: Column, consensus: Column) -> Column:
    """Note what a disputed price would be if the page's own pack size were right."""
    implied = p["amount"] / (consensus / DIVISOR)
    same = V.known(v) & F.coalesce(gap(implied, v["value"]) <= TOLERANCE, lit(False))
    ask = V.has_status(v, V.DISPUTED) & F.coalesce((p["amount"] != 0) & (consensus != 0), lit(False))
    return F.when(ask & ~same, V.noted(v, F.concat(
        lit("with the pack size the page states it would be "),
        F.format_string("%.2f", implied), lit(" "), v["unit"]))).otherwise(v)
