"""How much is in the pack, checked against every other statement of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfproof.functions import values as V
from shelfproof.functions.text import group, lookup, matches, number
from shelfproof.functions.values import cases, filled, let, lit, nth, number_text
from shelfproof.operators import variation

# Tolerance, units and phrases of pack statements.
TOLERANCE = 0.15
UNIT_GRAMS = {"g": 1.0, "gr": 1.0, "gramm": 1.0, "kg": 1000.0, "ml": 1.0, "l": 1000.0}
UNIT_DIMENSION = {"g": "mass", "gr": "mass", "gramm": "mass", "kg": "mass",
                  "ml": "volume", "l": "volume"}
_UNIT = "gramm|kg|gr|ml|g|l"
_COUNT = r"(\d{1,3})(?![\d,.])"
_NO_UNIT = rf"(?!\s*(?:{_UNIT})\b)"
_FLAGS = "(?iU)"
TIMES_WEIGHT = _FLAGS + rf"{_COUNT}\s*[x×]\s*(\d[\d.,]*)\s*({_UNIT})\b"
WEIGHT_THEN_PACK = (_FLAGS + rf"(\d[\d.,]*)\s*({_UNIT})\b[^()]{{0,12}}\("
                    rf"\s*(?:{_COUNT}\s*er[- ]?Pack|Pack\s+of\s+{_COUNT})\s*\)?")
PACKS_OF_WEIGHT = (_FLAGS + rf"{_COUNT}\s*(?:packung(?:en)?|packs?|stück)\s*(?:mit|à|a|of|von)?\s*"
                   rf"(\d[\d.,]*)\s*({_UNIT})\b")
LEADING_COUNT = _FLAGS + rf"^\s*{_COUNT}\s*[x×]\s*(?=\D)"
PACK_COUNT = (_FLAGS + rf"(?:packung\s+mit\s+{_COUNT}{_NO_UNIT}|{_COUNT}\s*er[- ]?pack"
              rf"|pack(?:ung)?\s+of\s+{_COUNT}{_NO_UNIT})")
ANY_WEIGHT = _FLAGS + rf"(\d[\d.,]*)\s*({_UNIT})\b"

#: A statement of pack content: its size, the field it stands in, the words.
HINT = "struct<grams: double, field: string, quote: string>"
HINTS = f"array<{HINT}>"


def gap(a: Column, b: Column) -> Column:
    """Relative distance of two numbers, 0 when equal."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), lit(1e-9))


def _grams(amount: Column, unit: Column) -> Column:
    return number(amount, ",") * lookup(UNIT_GRAMS, F.lower(unit))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, lit(pattern), lit(0))


def _hint(grams: Column, field, quote: Column) -> Column:
    return F.struct(grams.cast("double").alias("grams"), V.col(field).cast("string").alias("field"),
                    quote.alias("quote"))


def _no_hints() -> Column:
    return F.array().cast(HINTS)


def size_label_grams(label: Column) -> Column:
    """Grams of a size label that carries no count, else NULL."""
    counted = matches(label, TIMES_WEIGHT) | matches(label, WEIGHT_THEN_PACK) \
        | matches(label, PACKS_OF_WEIGHT)
    return F.when(~counted, _grams(group(label, ANY_WEIGHT, 1), group(label, ANY_WEIGHT, 2)))


def _pack_count(phrase: Column) -> Column:
    return F.coalesce(*[group(phrase, PACK_COUNT, i) for i in (1, 2, 3)]).cast("int")


def _bare_counts(text: Column) -> Column:
    """Pack counts stated without a weight of their own, in reading order."""
    return V.plus(F.transform(_all(text, PACK_COUNT), _pack_count),
                  group(text, LEADING_COUNT, 1).cast("int"))


def _hints_in(field: str, text: Column) -> Column:
    """Every counted statement of content in one text; a pack of nought grams states nothing."""
    def counted(pattern: str, count, amount: int, unit: int) -> Column:
        return F.transform(_all(text, pattern), lambda m: _hint(
            count(m).cast("double") * F.nullif(_grams(group(m, pattern, amount), group(m, pattern, unit)), lit(0.0)),
            field, m))

    per_unit = _grams(group(text, ANY_WEIGHT, 1), group(text, ANY_WEIGHT, 2))
    bare = let(per_unit, lambda w: F.when(w > 0, F.transform(
        F.filter(_bare_counts(text), lambda n: n > 1),
        lambda n: _hint(n * w, field, F.concat(n.cast("string"), lit(" x "), number_text(w),
                                               lit(" g"))))))
    found = F.concat(
        counted(TIMES_WEIGHT, lambda m: group(m, TIMES_WEIGHT, 1), 2, 3),
        counted(WEIGHT_THEN_PACK, lambda m: F.coalesce(group(m, WEIGHT_THEN_PACK, 3),
                                                       group(m, WEIGHT_THEN_PACK, 4)), 1, 2),
        counted(PACKS_OF_WEIGHT, lambda m: group(m, PACKS_OF_WEIGHT, 1), 2, 3),
        F.coalesce(bare, _no_hints()))
    # Digits first: most texts state no weight at all and need no regex scan.
    return F.when(matches(text, ANY_WEIGHT), found).otherwise(_no_hints())


def pack_hints(title: Column, size_name: Column, label: Column) -> Column:
    """Independent statements of the whole content, strongest source first."""
    labelled = let(size_label_grams(label), lambda g: F.when(
        g > 0, F.array(_hint(g, "variation.size_name", label))))
    hints = F.concat(
        F.coalesce(labelled, _no_hints()),
        _hints_in("variation.size_name", F.coalesce(label, lit(""))),
        _hints_in("title", F.coalesce(title, lit(""))),
        _hints_in("package.size_name", F.coalesce(size_name, lit(""))))
    return F.filter(hints.cast(HINTS), lambda h: h["grams"].isNotNull())


def consensus(hints: Column) -> Column:
    """The size most hints agree on; the first of equals; NULL without hints."""
    voted = F.transform(hints, lambda h, i: F.struct(
        F.size(F.filter(hints, lambda o: gap(o["grams"], h["grams"]) <= TOLERANCE)).alias("votes"),
        (-i).alias("first"), h["grams"].alias("grams")))
    return F.array_max(voted)["grams"]


def statement_texts(title: Column, size_name: Column, label: Column, bullets: Column,
                    description: Column) -> Column:
    """Texts in which a listing may state its own bare weight."""
    def one(field, text) -> Column:
        return F.struct(V.col(field).cast("string").alias("field"),
                        F.coalesce(text, lit("")).alias("text"))

    listed = F.transform(F.coalesce(bullets, F.array().cast("array<string>")),
                         lambda b, i: one(F.format_string("content.feature_bullets[%d]", i), b))
    return F.concat(F.array(one("title", title), one("package.size_name", size_name),
                            one("variation.size_name", label)),
                    listed, F.array(one("content.description", description)))


def states_pack_count(texts: Column, item_count: Column) -> Column:
    """Does anything on the page claim more than one unit?"""
    def many(pattern: str, *groups: int):
        return lambda text: F.exists(_all(text, pattern), lambda m: F.coalesce(
            F.coalesce(*[group(m, pattern, g) for g in groups]).cast("int") > 1, lit(False)))

    tests = (many(TIMES_WEIGHT, 1), many(PACKS_OF_WEIGHT, 1), many(WEIGHT_THEN_PACK, 3, 4))
    return F.coalesce(item_count > 1, lit(False)) | F.exists(texts, lambda t: (
        F.exists(_bare_counts(t["text"]), lambda n: n > 1)
        | tests[0](t["text"]) | tests[1](t["text"]) | tests[2](t["text"])))


def bare_weights(texts: Column, item_count: Column, unit: Column) -> Column:
    """Uncounted weights the listing states about itself, in its own dimension only.

    Empty as soon as anything claims more than one unit: a bare weight then
    describes one of them.
    """
    wanted = lookup(UNIT_DIMENSION, F.lower(F.coalesce(unit, lit(""))))
    found = F.flatten(F.transform(texts, lambda t: F.transform(_all(t["text"], ANY_WEIGHT), lambda m: F.struct(
        _grams(group(m, ANY_WEIGHT, 1), group(m, ANY_WEIGHT, 2)).alias("grams"),
        t["field"].alias("field"), m.alias("quote"),
        lookup(UNIT_DIMENSION, F.lower(group(m, ANY_WEIGHT, 2))).alias("dimension")))))
    same = F.filter(found, lambda f: (f["grams"] > 0)
                    & (wanted.isNull() | (f["dimension"] == wanted)))
    return F.when(states_pack_count(texts, item_count), _no_hints()).otherwise(
        F.transform(same, lambda f: _hint(f["grams"], f["field"], f["quote"])))


def outweighs_package(package: Column) -> Column:
    """One item filed as heavier than the whole package."""
    item, whole = package["item_weight_base"], package["package_weight_base"]
    return F.coalesce((item > 0) & (whole > 0) & (item > whole), lit(False))


def _as_evidence(h: Column) -> Column:
    return F.array(V.evidence(h["field"], h["quote"]))


def reconcile(package: Column, hints: Column, bare: Column) -> Column:
    """The stated total as a value struct.

    One agreeing hint confirms it whatever the others say; only hints that all
    disagree dispute it; bare weights are asked last and can only confirm.
    """
    total = package["total_quantity_base"]
    unit = F.coalesce(filled(package["total_quantity_unit"]), lit("g"))
    origin = F.coalesce(filled(package["total_quantity_source"]), lit("unknown"))
    base = V.value(total, status=V.UNVERIFIED, unit=unit, source=V.ATTRIBUTES, evidence=[
        V.evidence(F.concat(lit("package.total_quantity_base ("), origin, lit(")")),
                   F.concat(number_text(total), lit(" "), unit))])
    close = lambda h: gap(h["grams"], total) <= TOLERANCE
    agreeing = nth(F.filter(hints, close), 0)
    confirming = nth(F.filter(bare, close), 0)
    from_item = origin.isin("item_weight_x_count", "item_weight")
    against = F.transform(F.slice(hints, 1, 3), lambda h: V.evidence(
        h["field"], F.concat(h["quote"], lit(" -> "), number_text(h["grams"]), lit(" "), unit)))
    overweight = F.array(V.evidence(
        "raw_tables (item weight, package weight)",
        F.concat(lit("one item "), number_text(package["item_weight_base"]),
                 lit(" g, whole package "), number_text(package["package_weight_base"]), lit(" g"))))

    def decide(v: Column) -> Column:
        return cases(
            (outweighs_package(package) & from_item, V.disputed(
                v, "computed from an item weight that the page contradicts", overweight)),
            (agreeing.isNotNull(), V.trusted(v, more_evidence=_as_evidence(agreeing))),
            (F.size(hints) > 0, V.disputed(
                v, "every other statement of the pack size disagrees with the filed one", against)),
            (confirming.isNotNull(), V.trusted(
                v, "the listing's own text states this weight and claims no second unit",
                more_evidence=_as_evidence(confirming))),
            otherwise=V.noted(v, "nothing else on the page states the pack size"))

    return F.when(F.coalesce(total != 0, lit(False)), let(base, decide)) \
            .otherwise(V.unknown("no usable pack quantity is published"))


def listing_hints() -> Column:
    """``pack_hints`` over the columns of a listing."""
    return pack_hints(F.col("title"), F.col("package.size_name"),
                      variation.size_label(F.col("variation"), F.col("asin")))


def listing_bare_weights() -> Column:
    texts = statement_texts(
        F.col("title"), F.col("package.size_name"),
        variation.size_label(F.col("variation"), F.col("asin")),
        F.col("content.feature_bullets"), F.col("content.description"))
    return let(texts, lambda t: bare_weights(t, F.col("package.item_count"),
                                             F.col("package.total_quantity_unit")))
