"""Ratings checked by their histogram, and what a review sample may say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.functions import spans
from shelfproof.functions import values as V
from shelfproof.functions.text import matches
from shelfproof.functions.values import cases, expr, let, lit, number_text, unfold

# Star weights, tolerance of the average, thin evidence, and the
# percent range a whole-percent histogram may sum to.
STAR_WEIGHT = {"five_star": 5, "four_star": 4, "three_star": 3, "two_star": 2, "one_star": 1}
AVERAGE_TOLERANCE = 0.25
THIN_EVIDENCE = 20
COMPLETE = (98, 102)


def share(histogram: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(histogram, lit(key)), lit(0))


def covered(histogram: Column) -> Column:
    """Percent of all ratings the histogram covers, 0 without one."""
    return F.coalesce(F.aggregate(F.map_values(histogram), lit(0), lambda a, x: a + x), lit(0))


def implied_average(histogram: Column) -> Column:
    """The average the histogram implies, NULL when it is empty."""
    weighted = sum((share(histogram, k) * w for k, w in STAR_WEIGHT.items()), lit(0))
    total = covered(histogram)
    return F.when(total != 0, weighted / total)


def shown(histogram: Column) -> Column:
    return F.concat_ws(" · ", *[F.when(F.try_element_at(histogram, lit(k)).isNotNull(), F.concat(
        lit(f"{stars}★ "), share(histogram, k).cast("string"), lit("%")))
        for k, stars in STAR_WEIGHT.items()])


def _complete(histogram: Column) -> Column:
    return covered(histogram).between(*COMPLETE)


def _thin(count: Column) -> Column:
    return F.coalesce(count < THIN_EVIDENCE, lit(False))


def rating(r: Column, histogram: Column) -> Column:
    """The published average: confirmed, doubted or left alone by the histogram."""
    base = V.value(r["value"], status=V.UNVERIFIED, unit="stars", source=V.PUBLISHED,
                   evidence=[V.evidence("rating.text", F.coalesce(r["text"], lit("")))])
    proof = F.array(V.evidence("reviews.histogram_percent", shown(histogram)))

    def decide(v: Column) -> Column:
        return let(implied_average(histogram), lambda implied: cases(
            (implied.isNull(), V.noted(v, "no histogram confirms this average")),
            (~_complete(histogram), V.disputed(v, F.concat(
                lit("the histogram covers "), covered(histogram).cast("string"),
                lit("% of the ratings")))),
            (F.abs(implied - r["value"]) > AVERAGE_TOLERANCE, V.disputed(v, F.concat(
                lit("the histogram implies "), F.format_string("%.2f", implied), lit(" stars")), proof)),
            (_thin(r["count"]), V.noted(v, F.concat(
                lit("too few ratings to mean much: "), r["count"].cast("string")))),
            otherwise=V.trusted(v, F.concat(
                lit("the histogram implies "), F.format_string("%.2f", implied), lit(" stars")),
                more_evidence=proof)))

    return F.when(r["value"].isNull(), V.unknown("no average rating is published")) \
            .otherwise(let(base, decide))


def negative_share(r: Column, histogram: Column) -> Column:
    """Percent of all ratings at one or two stars, from the complete histogram only."""
    bad = share(histogram, "one_star") + share(histogram, "two_star")
    return cases(
        (F.coalesce(F.size(histogram) <= 0, lit(True)), V.unknown("no histogram on the page")),
        (~_complete(histogram), V.unknown("the histogram does not cover all ratings")),
        otherwise=V.value(
            bad, unit="%", source=V.STRUCTURED,
            status=F.when(_thin(r["count"]), V.UNVERIFIED).otherwise(V.TRUSTED),
            evidence=[V.evidence("reviews.histogram_percent", shown(histogram))],
            notes=F.array_compact(F.array(F.when(_thin(r["count"]), F.concat(
                lit("computed over only "), r["count"].cast("string"), lit(" ratings")))))))


def _cards(reviews: Column) -> Column:
    return reviews["sample"]


def sample(r: Column, reviews: Column) -> Column:
    """The number of rendered cards with every caveat; never better than unverified."""
    cards = _cards(reviews)
    n = F.size(cards)
    foreign = F.filter(cards, lambda c: F.coalesce(~c["home_marketplace"], lit(False)))
    countries = F.array_sort(F.array_distinct(F.transform(foreign, lambda c: c["country"])))
    variants = F.array_sort(F.array_distinct(F.filter(
        F.transform(cards, lambda c: c["variant"]), lambda v: F.coalesce(v != "", lit(False)))))
    unbought = F.size(F.filter(cards, lambda c: ~F.coalesce(c["verified"], lit(False))))

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else lit(p) for p in parts])

    pooled = F.size(variants) > 1
    return F.when(F.coalesce(n > 0, lit(False)), V.value(
        n, status=V.UNVERIFIED, unit="reviews", source=V.STRUCTURED,
        notes=F.array_compact(F.array(
            F.when(r["count"] > 0, text(n, " of ", r["count"], " ratings are shown, chosen by the shop"))
             .otherwise(text(n, " cards are shown, chosen by the shop")),
            F.when(F.size(foreign) > 0, text(F.size(foreign), " of ", n, " come from another marketplace: ",
                                             F.array_join(countries, ", "))),
            F.when(pooled, text("pooled across ", F.size(variants), " variants: ",
                                F.array_join(F.slice(variants, 1, 4), "; "))),
            F.when(unbought > 0, text(unbought, " of ", n, " are not verified purchases")))),
        flags=F.array_compact(F.array(F.when(pooled, lit("pooled_variants")))))) \
        .otherwise(V.unknown("no review text is shown"))


def caveats(reviews: Column) -> Column:
    """``STRUCT<cards, foreign, variants, unverified>`` of a review sample."""
    return F.struct(
        F.size(_cards(reviews)).alias("cards"),
        F.size(F.filter(_cards(reviews), lambda c: F.coalesce(~c["home_marketplace"], lit(False)))).alias("foreign"),
        F.size(F.array_distinct(F.filter(F.transform(_cards(reviews), lambda c: c["variant"]),
                                         lambda v: F.coalesce(v != "", lit(False))))).alias("variants"),
        F.size(F.filter(_cards(reviews), lambda c: ~F.coalesce(c["verified"], lit(False)))).alias("unverified"))


def told(sample: str, patterns: list[str]) -> Column:
    """Cards in which any of the patterns occurs, with their place and text: one pass, whatever the number of patterns."""
    either = "(?iU)" + "|".join(f"(?:{p})" for p in patterns)
    cards = (f"transform({sample}, (q_one, q_at) -> named_struct('i', q_at, 'card', q_one, 'text',"
             " trim(concat(coalesce(q_one.title, ''), '. ', coalesce(q_one.text, '')))))")
    return expr(f"filter({cards}, q_card -> {spans.matches('q_card.text', either)})")


def search(cards: str, pattern: str, limit: int = 3, home_only: bool = False,
           max_stars: float | None = None, min_stars: float | None = None) -> Column:
    """Quotes from the cards that match, in card order, at most ``limit``.

    ``cards`` names a ``told`` column.
    """
    tests = ["true"]
    if home_only:
        tests.append("coalesce(q_card.card.home_marketplace, true)")
    if max_stars is not None:
        tests.append(f"coalesce(q_card.card.rating <= {max_stars}, false)")
    if min_stars is not None:
        tests.append(f"coalesce(q_card.card.rating >= {min_stars}, false)")
    stars = "if(q_card.card.rating is null, '', concat(' (', regexp_replace(cast(q_card.card.rating as string), '[.]0$', ''), '★)'))"
    hits = (f"transform(filter({cards}, q_card -> {' and '.join(tests)} and {spans.matches('q_card.text', pattern)}), q_card ->"
            f" named_struct('field', concat('reviews.sample[', q_card.i, ']', {stars}),"
            f" 'quote', {spans.quoted_match('q_card.text', pattern)}))")
    return expr(f"coalesce(slice({hits}, 1, {limit}), {V.NO_EVIDENCE})")


def signal(cards: str, pattern: str, label: str, **kw) -> Column:
    """Found in the sample: unverified.  Not found: unknown, never "not claimed"."""
    return let(search(cards, pattern, **kw), lambda hits: F.when(F.size(hits) > 0, V.value(
        1.0, status=V.UNVERIFIED, source=V.TEXT, evidence=hits,
        notes=[F.concat(lit(f"{label}: reported by at least "), F.size(hits).cast("string"),
                        lit(" of the reviews shown"))]))
        .otherwise(V.unknown(f"{label}: not in the reviews shown, which proves nothing")))


def signal_hits(cards: DataFrame, signals: list[tuple[str, str, float | None, float | None]], key: str,
                order: str, limit: int = 3) -> DataFrame:
    """Review signals over a long card table (key, order, rating, home_marketplace, text).

    ``signals`` is (key, pattern, least stars, most stars).  A card expands only
    into the signals it reports; the rank per (key, signal) is limited, so it
    cuts each map task's rows before the shuffle.  Every key keeps a row per
    signal: found is unverified, not found is unknown.
    """
    def reports(name: str, pattern: str, least: float | None, most: float | None) -> Column:
        ok = matches(F.col("text"), pattern)
        if least is not None:
            ok = F.coalesce(F.col("rating") >= least, lit(False)) & ok
        if most is not None:
            ok = F.coalesce(F.col("rating") <= most, lit(False)) & ok
        return F.when(ok, lit(name))

    found = unfold(cards, F.array_compact(F.array(*[reports(*s) for s in signals])), "signal", key, order)
    kept = found.withColumn("_r", F.row_number().over(Window.partitionBy(key, "signal").orderBy(order))) \
                .where(F.col("_r") <= limit)
    hits = kept.groupBy(key, "signal").agg(F.count(lit(1)).alias("hits"))
    asked = cards.select(key).distinct().select(key, F.explode(F.array(*[lit(s[0]) for s in signals])).alias("signal"))
    return asked.join(hits, [key, "signal"], "left").select(
        key, "signal", F.coalesce("hits", lit(0)).alias("hits"),
        F.when(F.col("hits") > 0, lit(V.UNVERIFIED)).otherwise(lit(V.UNKNOWN)).alias("status"))
