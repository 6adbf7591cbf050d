"""Tyre mounting paste: classified by the title, smallest pack first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.categories import base as B
from shelfproof.functions import spans, values as V
from shelfproof.functions.text import IU, matches
from shelfproof.functions.values import cases, expr, lit
from shelfproof.operators import search as S
from shelfproof.operators.validate import Profile
from shelfproof.rules import paste as R

AXES = (
    B.Axis("quantity", "Pack size", better="lower", tolerance=1.0),
    B.Axis("price", "Price", better="lower", tolerance=0.01),
    B.Axis("price_per_base", "Price per kg / l", caveat="shown, not ranked"),
)
CLAIMS = tuple(B.Claim(k, label, p, adverse) for k, label, p, adverse in R.CLAIMS)


def _disqualified(title: Column, pattern: str, head: Column) -> Column:
    """A match before the product word, or one that says what the product is for."""
    found = spans.spans("coalesce(title, '')", IU + pattern)
    return F.exists(expr(found), lambda s: (s["lo"] < head) | matches(
        F.substr(title, lit(1), s["lo"]), IU + R.FOR_BEFORE))


def _from_body(fields: str, proof: Column) -> Column:
    """A silent title is settled by the description, and then only unverified."""
    def hits(pattern: str) -> Column:
        return S.search(fields, IU + pattern, limit=1, only=R.BODY_FIELDS)

    def says(pattern: str) -> Column:
        return S.states(fields, IU + pattern, only=R.BODY_FIELDS)

    return F.when(says(R.PRODUCT) & says(R.TYRE_CONTEXT) & ~says(R.WRONG_PRODUCT) & ~says(R.PURPOSE), V.value(
        text=R.KEY, status=V.UNVERIFIED, evidence=hits(R.PRODUCT),
        notes=["the title names no product class; decided on the description"])).otherwise(V.value(
            text="other", status=V.TRUSTED, evidence=proof, notes=["the title names no mounting paste"]))


def classify() -> Column:
    title = F.coalesce(F.col("title"), lit(""))
    proof = F.array(V.evidence("title", B.head(title)))
    head = F.regexp_instr(title, lit(IU + R.PRODUCT)) - 1

    def other(note: str) -> Column:
        return V.value(text="other", status=V.TRUSTED, evidence=proof, notes=[note])

    return cases(
        (title == "", V.unknown("no title to classify")),
        (~matches(title, IU + R.PRODUCT), _from_body("_fields", proof)),
        (matches(title, IU + R.PURPOSE), other("the title says what it is for, and it is not tyres")),
        (_disqualified(title, R.WRONG_PRODUCT, head), other("a different product class")),
        (_disqualified(title, R.ACCESSORY, head), other("an accessory")),
        otherwise=V.value(text=R.KEY, status=V.TRUSTED, evidence=proof))


def is_bundle() -> Column:
    return matches(F.coalesce(F.col("title"), lit("")), IU + R.BUNDLE)


def stated(fields: str, claim: B.Claim) -> Column:
    """Hits that survive a negation beside them and the claim's own negated phrases."""
    banned = R.NEGATED.get(claim.key)
    v = B.stated(fields, claim, scope="page", affirmative=True, exclude=banned and IU + banned)
    return V.let(v, lambda x: F.when(is_bundle() & V.has_status(x, V.TRUSTED), V.noted(
        x, "the listing is a kit, so this may describe another item in it")).otherwise(x))


def suitability(claims: Column) -> Column:
    """Which decisive claims are answered, and which adverse ones are made."""
    def trusted(keys) -> Column:
        return F.array_compact(F.array(*[F.when(V.has_status(
            F.try_element_at(claims, lit(k)), V.TRUSTED), lit(k)) for k in keys]))

    return F.struct(trusted(R.DECISIVE).alias("answered"),
                    trusted([c.key for c in CLAIMS if c.adverse]).alias("adverse"),
                    lit(len(R.DECISIVE)).alias("total"))


def consistent(v: dict[str, Column]) -> dict[str, Column]:
    """Dispute what a mineral-oil base or a lasting lubricant rules out."""
    base, lubricant = v["mineral_oil_base"], v["permanent_lubricant"]
    on_oil = V.has_status(base, V.TRUSTED)
    out = dict(v)

    def dispute(key: str, when: Column, note: str, by: Column) -> None:
        x = out[key]
        out[key] = F.when(when & V.has_status(x, V.TRUSTED), V.disputed(
            x, note, F.slice(by["evidence"], 1, 1))).otherwise(x)

    dispute("mineral_oil_free", on_oil, "the page also files a mineral-oil base", base)
    dispute("dries_out", on_oil, "a mineral-oil base does not evaporate", base)
    dispute("dries_out", V.has_status(lubricant, V.TRUSTED), "the page also sells it on staying lubricating",
            lubricant)
    return out


def fill() -> list[dict[str, Column]]:
    checked = consistent({c.key: F.col(f"_claims.{c.key}") for c in CLAIMS})
    return [
        {"_claims": V.named(**{c.key: stated("_fields", c) for c in CLAIMS})},
        {"axes": B.value_map({"quantity": F.col("quantity"), "price": F.col("price_value"),
                              "price_per_base": F.col("price_per_base")}),
         "claims": B.value_map(checked)},
        {"suitability": suitability(F.col("claims"))}]


CATEGORY = B.register(B.Category(
    key=R.KEY, label=R.LABEL, axes=AXES, claims=CLAIMS, classify=classify, fill=fill,
    profile=Profile(R.KEY, R.LABEL), default_axis="quantity"))
