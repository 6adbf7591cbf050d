"""Dry pasta: classified by breadcrumbs, made of what the declaration says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.categories import base as B
from shelfproof.functions import values as V
from shelfproof.functions.text import IU
from shelfproof.functions.values import cases, lit, nth
from shelfproof.operators import nutrition, search as S
from shelfproof.operators.validate import Profile
from shelfproof.rules import pasta as R

AXES = (
    B.Axis("price_per_base", "Price per kg", better="lower", tolerance=0.01),
    B.Axis("quantity", "Pack size"),
    B.Axis("raw_materials", "Made of", render=lambda v: F.array_join(F.transform(
        F.split(v["text"], ","), lambda k: F.translate(k, "_", " ")), ", ")),
    B.Axis("protein_g", "Protein", better="higher", tolerance=1.0),
    B.Axis("energy_kcal", "Energy"),
    B.Axis("fiber_g", "Fibre"),
)
CLAIMS = tuple(B.Claim(*c) for c in R.CLAIMS)
DECLARATION = ("food.ingredients",)


def any_word(items: Column, words) -> Column:
    """Does any lower-cased item contain one of the words?"""
    return F.coalesce(F.exists(items, lambda c: reduce(
        lambda acc, w: acc | F.lower(c).contains(w), words, lit(False))), lit(False))


def classify() -> Column:
    crumbs = F.col("breadcrumbs")
    trail = F.array(V.evidence("breadcrumbs", F.array_join(crumbs, " > ")))
    fresh = S.search("_fields", IU + R.FRESH, limit=1)

    def other(note: str, proof: Column = trail) -> Column:
        return V.value(text="other", status=V.TRUSTED, evidence=proof, notes=[note])

    return cases(
        (F.coalesce(F.size(crumbs) <= 0, lit(True)), V.unknown("no breadcrumbs are published")),
        (any_word(crumbs, R.OTHER_BREADCRUMBS), other("filed outside dry pasta")),
        (~any_word(crumbs, R.BREADCRUMBS), other("not filed as pasta")),
        (F.size(fresh) > 0, other("described as fresh pasta", F.concat(trail, fresh))),
        otherwise=V.value(text=R.KEY, status=V.TRUSTED, evidence=trail))


def raw_materials(fields: str, declared: Column) -> Column:
    """Materials of the declaration, else of any text and then unverified."""
    def hits(only) -> Column:
        rows = F.array(*[F.struct(lit(key).alias("key"), nth(S.search(
            fields, IU + pattern, limit=1, only=only), 0).alias("e"))
            for key, pattern in R.RAW_MATERIALS])
        return F.filter(rows, lambda r: r["e"].isNotNull())

    found = F.when(declared, hits(DECLARATION)).otherwise(hits(None))
    return V.let(found, lambda h: F.when(F.size(h) > 0, V.value(
        text=F.array_join(F.transform(h, lambda r: r["key"]), ","),
        status=F.when(declared, V.TRUSTED).otherwise(V.UNVERIFIED),
        source=F.when(declared, V.STRUCTURED).otherwise(V.TEXT),
        evidence=F.transform(h, lambda r: r["e"]),
        notes=F.array_compact(F.array(F.when(~declared, lit("no ingredient declaration is published"))))))
        .otherwise(V.unknown("neither a declaration nor a description of the raw material")))


def pure_durum(materials: Column, fields: str) -> Column:
    """A disputed extra claim when "100% durum" meets a declaration with more in it."""
    keys = F.split(materials["text"], ",")
    clash = F.filter(keys, lambda k: k.isin(*R.NOT_PURE))
    hits = S.search(fields, IU + R.PURE_DURUM, limit=1)
    return F.when(V.has_status(materials, V.TRUSTED) & (F.size(clash) > 0) & (F.size(hits) > 0), V.value(
        1.0, status=V.DISPUTED, source=V.TEXT, evidence=F.concat(hits, materials["evidence"]),
        notes=[F.concat(lit("the declaration also lists "), F.array_join(clash, ", "))]))


def drying(fields: str) -> Column:
    out = {}
    for key, pattern in R.DRYING_DETAIL:
        hits = S.search(fields, IU + pattern, limit=1)
        out[key] = F.when(F.size(hits) > 0, V.value(1.0, status=V.UNVERIFIED, source=V.TEXT, evidence=hits))
    return B.value_map(out)


def fill() -> list[dict[str, Column]]:
    fields = "_fields"
    declared = F.coalesce(F.col("food.ingredients.text") != "", lit(False))
    return [
        {"raw_materials": raw_materials(fields, declared)},
        {"axes": B.value_map({
            "price_per_base": F.col("price_per_base"), "quantity": F.col("quantity"),
            "raw_materials": F.col("raw_materials"),
            **{k: nutrition.of(F.col("nutrition"), k) for k in ("protein_g", "energy_kcal", "fiber_g")}}),
         "claims": B.value_map({
             **{c.key: B.stated("_said", c) for c in CLAIMS},
             "pure_durum": pure_durum(F.col("raw_materials"), fields)}),
         "drying": drying(fields)}]


CATEGORY = B.register(B.Category(
    key=R.KEY, label=R.LABEL, axes=AXES, claims=CLAIMS, classify=classify, fill=fill,
    profile=Profile(R.KEY, R.LABEL, R.NUTRITION_BANDS, R.PRICE_BAND), default_axis="price_per_base"))
