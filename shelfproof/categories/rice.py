"""Basmati rice: authenticity, what buyers report, and a score that names its gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.categories import base as B
from shelfproof.categories.pasta import any_word
from shelfproof.functions import values as V
from shelfproof.functions.labels import profile as marketplace_profile
from shelfproof.functions.text import IU, matches
from shelfproof.functions.values import cases, filled, lit
from shelfproof.operators import reviews, search as S
from shelfproof.operators.validate import Profile
from shelfproof.rules import rice as R

AXES = (
    B.Axis("price_per_base", "Price per kg", better="lower", tolerance=0.05),
    B.Axis("review_negative_share", "Share of 1-2 star ratings", better="lower", tolerance=1.0),
    B.Axis("review_rating", "Average rating", better="higher", tolerance=0.1),
    B.Axis("quantity", "Pack size", caveat="shown, not ranked"),
)
CLAIMS = tuple(B.Claim(k, label, p, adverse) for k, label, p, adverse in R.CLAIMS)
SIGNALS = ([(k, label, p, {"min_stars": R.POSITIVE_MIN_STARS}) for k, label, p in R.POSITIVE_SIGNALS]
           + [(k, label, p, {"max_stars": R.NEGATIVE_MAX_STARS}) for k, label, p in R.NEGATIVE_SIGNALS])


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), lit(""))


def says_basmati(text: Column, language: Column) -> Column:
    """German accepts the word inside a compound, other languages only alone."""
    return F.when(language == "de", matches(text, IU + r"\bbasmati")) \
            .otherwise(matches(text, IU + r"\bbasmati\b"))


def classify() -> Column:
    title, declared = _text("title"), _text("food.ingredients.text")
    host = F.coalesce(filled(F.col("marketplace")), filled(F.col("product_url")),
                      filled(F.col("canonical_url")))
    language = marketplace_profile(host)["language"]
    by_title = V.evidence("title", B.head(title))
    by_declaration = V.evidence("food.ingredients", B.head(declared))
    named = says_basmati(title, language)
    proof = F.when(named, F.array(by_title)).otherwise(F.array(by_title, by_declaration))

    def other(note: str, evidence: Column = proof) -> Column:
        return V.value(text="other", status=V.TRUSTED, evidence=evidence, notes=[note])

    return cases(
        (title == "", V.unknown("no title to classify")),
        (any_word(F.col("breadcrumbs"), R.OTHER_BREADCRUMBS), other("filed outside dry rice", F.array(by_title))),
        (~named & ~says_basmati(declared, language), other(
            "neither title nor declaration names basmati", F.array(by_title))),
        (matches(title, IU + R.NOT_DRY_RICE), other("not a bag of dry rice")),
        (matches(title, IU + R.MIXED), other("a blend, a set or another rice dish")),
        (matches(declared, IU + R.COOKED), other("the declaration is a cooked dish", F.array(by_declaration))),
        otherwise=V.value(text=R.KEY, status=V.TRUSTED, evidence=proof))


def grain_type(fields: str) -> Column:
    """First stated milling type in the listing's own fields; plain white only assumed."""
    options = []
    for key, pattern in R.GRAIN_TYPES:
        hits = S.search(fields, IU + pattern, limit=1, scope="self", affirmative=True)
        options.append(F.when(F.size(hits) > 0, V.value(
            text=key, status=V.TRUSTED, source=V.TEXT, evidence=hits)))
    return F.coalesce(*options, V.value(text="white", status=V.UNVERIFIED,
                                        notes=["the milling degree is not stated"]))


def cultivar(fields: str) -> Column:
    options = []
    for _, pattern, name, registered in R.CULTIVARS:
        note, flag = (("a registered variety", "registered_cultivar") if registered
                      else ("a trade grade, not a variety", "trade_grade"))
        options.append(F.when(S.states(fields, IU + pattern), V.value(
            text=name, status=V.UNVERIFIED, source=V.TEXT, notes=[note], flags=[flag],
            evidence=S.search(fields, IU + pattern, limit=1))))
    return F.coalesce(*options, V.value(status=V.NOT_CLAIMED, notes=["no variety is named"]))


def external_test(brand: Column, title: Column, manufacturer: Column) -> Column:
    """A laboratory result; trusted only if brand or manufacturer is the tested one."""
    options = []
    for pattern, tested, verdict, _, source, finding in R.EXTERNAL_TESTS:
        own = IU + r"(?<!\w)" + tested + r"(?!\w)"
        identity = F.array_compact(F.array(
            F.when(matches(brand, own), V.evidence("brand", brand)),
            F.when(matches(manufacturer, own), V.evidence("attributes.manufacturer", manufacturer))))
        proof = F.array(V.evidence(source, finding))
        options.append(F.when(
            matches(F.concat_ws(" ", brand, title), IU + pattern),
            F.when(F.size(identity) > 0, V.value(
                text=verdict, status=V.TRUSTED, source=V.PUBLISHED, evidence=F.concat(proof, identity),
                notes=[f"{source}: {finding}"]))
            .otherwise(V.value(text=verdict, status=V.UNVERIFIED, source=V.PUBLISHED, evidence=proof, notes=[
                f"{source}: {finding}, but only the title names {tested}"]))))
    return F.coalesce(*options, V.unknown("no independent laboratory result is known"))


def declaration_conflict(fields: str, grain: Column) -> Column:
    """Declaration and title describe different rice; NULL when they do not."""
    options = []
    for kind, pattern in R.DECLARATION_CONFLICT:
        def hit(field: str, pattern=pattern) -> Column:
            return F.size(S.search(fields, IU + pattern, limit=1, scope="self", only=(field,), affirmative=True)) > 0

        options.append(F.when((grain["text"] != kind) & hit("food.ingredients") & ~hit("title"), V.value(
            text=kind, status=V.DISPUTED, source=V.STRUCTURED,
            evidence=[V.evidence("food.ingredients", B.head(_text("food.ingredients.text"))),
                      V.evidence("title", B.head(_text("title")))],
            notes=[F.concat(lit(f"the declaration says {kind}, the title sells "), grain["text"])])))
    return F.coalesce(*options)


def consistent(v: dict[str, Column], grain: Column) -> dict[str, Column]:
    pure, broken, aged = v["pure_basmati"], v["is_broken"], v["aged"]
    return {**v,
            "pure_basmati": F.when(B.found(pure) & B.found(broken), V.disputed(
                pure, "sold as pure basmati and as broken rice", F.slice(broken["evidence"], 1, 1))).otherwise(pure),
            "aged": F.when((grain["text"] == "parboiled") & B.found(aged), V.disputed(
                aged, "declared parboiled as well", F.slice(grain["evidence"], 1, 1))).otherwise(aged)}


def _clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, lit(low)), lit(high))


def _plus(x: Column, when: Column, amount: float) -> Column:
    """Move a part score by ``amount``, within 0..1 on the side it moves to."""
    moved = F.least(x + amount, lit(1.0)) if amount > 0 else F.greatest(x + amount, lit(0.0))
    return F.when(when, moved).otherwise(x)


def _by(table: dict, key: Column, default: float) -> Column:
    return cases(*[(key == k, lit(x)) for k, x in table.items()], otherwise=lit(default))


def score_passes() -> list[dict[str, Column]]:
    """``score``: seven parts in 0..1, the weighted total, and what had to be guessed.

    Nothing is filled in by assumption: a part without evidence stays neutral,
    and the total moves toward neutral by the number of gaps.
    """
    claim = lambda k: B.found(F.try_element_at("claims", lit(k)))
    signal = lambda k: B.found(F.try_element_at("review_signals", lit(k)))
    grain, variety, external = F.col("grain_type"), F.col("cultivar"), F.col("external_test")
    origin = filled(F.try_element_at("attributes", lit("country_of_origin")))
    grown = matches(origin, IU + R.GROWING_COUNTRIES)
    tested = V.has_status(external, V.TRUSTED)
    negative, per_kg = F.col("review_negative_share"), F.col("price_per_base")

    registered = F.array_contains(variety["flags"], "registered_cultivar")
    authentic = cases((registered, lit(0.95)), (variety["text"].isNotNull(), lit(0.75)), otherwise=lit(0.5))
    authentic = _plus(authentic, claim("pure_basmati"), 0.12)
    authentic = _plus(authentic, claim("himalaya_origin"), 0.08)
    authentic = F.when(grown, _plus(authentic, lit(True), 0.10)).otherwise(
        _plus(authentic, origin.isNotNull(), -0.05))
    authentic = cases((tested & (external["text"] == "failed"), F.least(authentic, lit(0.15))),
                      (~tested, F.least(authentic, lit(R.CLAIM_CEILING))), otherwise=authentic)

    taste = reduce(lambda x, kw: x + F.when(signal(kw[0]), kw[1]).otherwise(0.0), R.TASTE_UP, lit(0.5))
    taste = _clip(reduce(lambda x, kw: x - F.when(signal(kw[0]), kw[1]).otherwise(0.0), R.TASTE_DOWN, taste))

    milled = _by(R.GRAIN_SCORE, grain["text"], 0.5)
    milled = F.when(V.has_status(grain, V.TRUSTED), milled).otherwise(0.5 + (milled - 0.5) * 0.5)
    for key, step in (("extra_long", 0.08), ("aged", 0.07)):
        milled = _plus(milled, claim(key), step)
    milled = F.when(claim("is_broken"), F.least(milled, lit(0.1))).otherwise(milled)
    for key, step in (("broken_grain", -0.25), ("foreign_matter", -0.15)):
        milled = _plus(milled, signal(key), step)

    states = [origin.isNotNull(), variety["text"].isNotNull(),
              F.coalesce(F.col("food.ingredients.text") != "", lit(False)),
              F.coalesce(F.size("food.nutrition.per_100g") > 0, lit(False)),
              claim("lab_tested"), claim("himalaya_origin"), V.has_status(F.col("quantity"), V.TRUSTED)]
    open_about = reduce(lambda a, s: a + s.cast("int"), states, lit(0)) / len(states)

    # The first test with a verdict stands for the verdict.
    first_by_verdict = {}
    for _, _, verdict, score, _, _ in R.EXTERNAL_TESTS:
        first_by_verdict.setdefault(verdict, score)
    measured = _by(first_by_verdict, external["text"], 0.5)
    healthy = _plus(_by(R.HEALTH_SCORE, grain["text"], 0.5), grown, 0.08)
    for key in ("lab_tested", "arsenic_tested"):
        healthy = _plus(healthy, claim(key), 0.03)
    healthy = cases((tested, measured), (V.known(external), 0.5 + (measured - 0.5) * 0.5), otherwise=healthy)
    healthy = _plus(healthy, signal("odd_smell"), -0.20)
    healthy = _plus(healthy, signal("insects") | signal("rancid"), -0.15)

    steady = F.when(V.usable(negative), _clip(1.0 - negative["value"] / 20.0)).otherwise(lit(0.5))
    for key, step in (("consistent", 0.10), ("batch_change", -0.25), ("not_as_described", -0.20)):
        steady = _plus(steady, signal(key), step)
    cards = reviews.caveats(F.col("reviews"))
    steady = _plus(steady, F.coalesce((cards["cards"] > 0) & (cards["unverified"] > cards["cards"] / 2),
                                      lit(False)), -0.15)

    cheap = F.when(V.usable(per_kg) & (per_kg["value"] != 0), _clip((12.0 - per_kg["value"]) / 10.0)).otherwise(0.5)

    any_signal = reduce(lambda a, s: a | signal(s[0]), SIGNALS, lit(False))
    gaps = F.array_compact(F.array(
        F.when(~V.known(external), lit("laboratory result")),
        F.when(~any_signal, lit("review signal")),
        F.when(variety["text"].isNull(), lit("variety")),
        F.when(~V.has_status(grain, V.TRUSTED), lit("milling degree")),
        F.when(origin.isNull(), lit("country of origin")),
        F.when(~V.usable(per_kg), lit("price per kg")),
        F.when(~V.usable(negative), lit("rating track record"))))

    parts = {"authenticity": authentic, "taste": taste, "grain": milled, "transparency": open_about,
             "health": healthy, "consistency": steady, "value": cheap}
    raw = reduce(lambda a, k: a + F.col(f"_parts.{k}") * R.WEIGHTS[k], R.WEIGHTS, lit(0.0))
    missing = F.size("_gaps") / R.EVIDENCE_CHECKS
    total = R.NEUTRAL + (raw - R.NEUTRAL) * (1 - R.SHRINK * missing)
    score = V.named(parts=F.col("_parts"), raw=F.round(raw, 1), total=F.round(total, 1),
                    evidence=F.round(1 - missing, 2), unknown=F.col("_gaps"))
    return [{"_parts": V.named(**{k: c.cast("double") for k, c in parts.items()}), "_gaps": gaps},
            {"score": F.when(B.is_match(CATEGORY), score)}]


def fill() -> list[dict[str, Column]]:
    fields = "_fields"
    checked = consistent({c.key: F.col(f"_claims.{c.key}") for c in CLAIMS}, F.col("grain_type"))
    return [
        {"_told": reviews.told("reviews.sample", [p for _, _, p, _ in SIGNALS])},
        {"grain_type": grain_type(fields), "cultivar": cultivar(fields),
         "external_test": external_test(_text("brand"), _text("title"), F.coalesce(F.try_element_at(
             "attributes", lit("manufacturer")), lit(""))),
         "review_signals": B.value_map({k: reviews.signal("_told", IU + p, label, limit=3, **stars)
                                        for k, label, p, stars in SIGNALS}),
         "_claims": V.named(**{c.key: B.stated("_said", c) for c in CLAIMS})},
        {"declaration_conflict": declaration_conflict(fields, F.col("grain_type")),
         "axes": B.value_map({k: F.col(k) for k in ("price_per_base", "review_negative_share",
                                                    "review_rating", "quantity")}),
         "claims": B.value_map(checked)},
        *score_passes()]


CATEGORY = B.register(B.Category(
    key=R.KEY, label=R.LABEL, axes=AXES, claims=CLAIMS, classify=classify, fill=fill,
    profile=Profile(R.KEY, R.LABEL, R.NUTRITION_BANDS, R.PRICE_BAND), default_axis="price_per_base"))
