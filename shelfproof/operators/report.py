"""Comparisons, corpus summary and cards as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.functions import values as V
from shelfproof.functions.values import cases, lit, nth, unfold
from shelfproof.operators import variation
from shelfproof.operators.ranking import matching, pack_size
from shelfproof.session import cut_lineage


def blocked(a: Column, b: Column) -> Column:
    """Why two values cannot be compared, NULL when they can."""
    def side(name: str, v: Column) -> Column:
        return cases(
            (~V.known(F.coalesce(v, V.unknown())), lit(f"the {name} has no value")),
            (V.has_status(v, V.DISPUTED), lit(f"the {name} value is disputed")),
            (V.has_status(v, V.UNVERIFIED), lit(f"the {name} value is unverified")),
            otherwise=lit(None).cast("string"))

    return F.coalesce(side("first", a), side("second", b))


def units_differ(a: Column, b: Column) -> Column:
    return F.coalesce((a["unit"] != "") & (b["unit"] != "") & (a["unit"] != b["unit"]), lit(False))


def axis_difference(a: Column, b: Column, better: Column, tolerance: Column) -> Column:
    """``STRUCT<outcome, winner, ratio>`` of two comparable values.

    Values in different units never have a winner; numbers closer than the
    tolerance do not differ; an axis without a direction, or over something
    that is not a number, can differ but not be won.
    """
    numeric = a["value"].isNotNull() & b["value"].isNotNull()
    directed = (better != "") & numeric
    same = a["value"].eqNullSafe(b["value"]) & a["text"].eqNullSafe(b["text"])
    low = F.least(F.abs(a["value"]), F.abs(b["value"]))
    high = F.greatest(F.abs(a["value"]), F.abs(b["value"]))
    won = directed & ~units_differ(a, b)
    outcome = cases(
        (~directed & same, lit("same")),
        (directed & units_differ(a, b), lit("other unit")),
        (~directed, F.when(units_differ(a, b), lit("other unit")).otherwise(lit("different"))),
        (F.abs(a["value"] - b["value"]) < tolerance, lit("same")),
        otherwise=lit("different"))
    return F.struct(
        outcome.alias("outcome"),
        F.when(won & (outcome == "different"), F.when(
            (a["value"] < b["value"]) == (better == "lower"), lit("A")).otherwise(lit("B"))).alias("winner"),
        F.when(won & (outcome == "different"), high / F.greatest(low, lit(1e-9))).alias("ratio"))


def pair_up(cards: DataFrame, pairs: DataFrame, keep: bool = True) -> DataFrame:
    """Pairs (left_asin, right_asin) with both cards.  Only the pairs asked for, never all.

    Both sides read the cards; ``keep`` checkpoints them, so the checks behind a
    card run once.
    """
    card = F.struct("asin", "category_key", "category", "axes", "claims", "offer", "quantity", "size_label")
    side = cards.select(F.col("asin").alias("_id"), card.alias("_card"))
    side = cut_lineage(side) if keep else side
    return (pairs
            .join(side.select(F.col("_id").alias("left_asin"), F.col("_card").alias("a")), "left_asin")
            .join(side.select(F.col("_id").alias("right_asin"), F.col("_card").alias("b")), "right_asin"))


def _pair_state() -> Column:
    """``other category``, ``same offer`` or ``rivals``."""
    ok = lambda s: F.coalesce(F.col(f"{s}.category.text") == F.col(f"{s}.category_key"), lit(False))
    return cases((~(ok("a") & ok("b")), lit("other category")),
                 (F.coalesce(F.col("a.offer") == F.col("b.offer"), lit(False)), lit("same offer")),
                 otherwise=lit("rivals"))


def compare(cards: DataFrame, pairs: DataFrame, axes, claims=(), default_axis: str = "") -> DataFrame:
    """One row per pair and axis or claim that says something about the two.

    Rivals are set against each other on every axis and on every claim that
    exactly one of them makes; two packs of one offer only on the default axis.
    """
    paired = pair_up(cards, pairs).withColumn("state", _pair_state())

    def row(kind: str, key: str, outcome: Column, winner: Column, ratio: Column, reason: Column) -> Column:
        return F.struct(lit(kind).alias("kind"), lit(key).alias("key"),
                        outcome.cast("string").alias("outcome"), winner.cast("string").alias("winner"),
                        ratio.cast("double").alias("ratio"), reason.cast("string").alias("reason"))

    nothing = lit(None)
    rows = []
    for axis in axes:
        a, b = [F.try_element_at(F.col(f"{s}.axes"), lit(axis.key)) for s in "ab"]
        why = blocked(a, b)
        d = axis_difference(a, b, lit(axis.better), lit(float(axis.tolerance)))
        rows.append(F.when(F.col("state") == "rivals", row(
            "axis", axis.key, F.when(why.isNotNull(), lit("blocked")).otherwise(d["outcome"]),
            F.when(why.isNull(), d["winner"]), F.when(why.isNull(), d["ratio"]), why)))
    for claim in claims:
        a, b = [F.try_element_at(F.col(f"{s}.claims"), lit(claim.key)) for s in "ab"]
        made_a, made_b = V.has_status(a, V.TRUSTED), V.has_status(b, V.TRUSTED)
        said = F.when(made_a, a["evidence"]).otherwise(b["evidence"])
        rows.append(F.when((F.col("state") == "rivals") & a.isNotNull() & b.isNotNull() & (made_a != made_b), row(
            "claim", claim.key, lit("declared by one" if claim.adverse else "stated by one"),
            F.when(made_a, lit("A")).otherwise(lit("B")), nothing, nth(said, 0)["quote"])))
    if default_axis:
        a, b = [F.try_element_at(F.col(f"{s}.axes"), lit(default_axis)) for s in "ab"]
        ok_a, ok_b = [V.usable(F.coalesce(v, V.unknown())) for v in (a, b)]
        winner = cases((ok_a & ok_b, F.when(a["value"] <= b["value"], lit("A")).otherwise(lit("B"))),
                       (ok_a, lit("A")), (ok_b, lit("B")), otherwise=lit(None).cast("string"))
        rows.append(F.when(F.col("state") == "same offer", row(
            "pack", default_axis, lit("same offer"), winner, nothing, F.concat_ws(" | ", *[pack_size(
                F.col(f"{s}.size_label"), F.col(f"{s}.quantity")) for s in "ab"]))))
    rows.append(F.when(F.col("state") == "other category", row(
        "category", "category", lit("nothing to compare"), nothing, nothing, nothing)))
    return unfold(paired, F.array_compact(F.array(*rows)), "r", "left_asin", "right_asin").select("left_asin", "right_asin", "r.*")


def summary(cards: DataFrame, axes, claims=(), order: str = "ord") -> DataFrame:
    """The corpus as (metric, key, n), each listing evaluated once.

    Everything that counts is emitted by a listing as narrow rows: (metric, key) pairs, its own offer under its id, and its
    matrix under the matrix's digest.  They are counted in one aggregate combined on the map side; then each
    matrix shown gives its members' offers once, a listing whose id is a member takes the offer of the first that claims it,
    and offers are counted like any other key.
    """
    match = F.coalesce(F.col("category.text") == F.col("category_key"), lit(False))

    def pair(metric: str, key, when: Column | None = None) -> Column:
        p = F.struct(lit(metric).alias("metric"), V.col(key).cast("string").alias("key"))
        return p if when is None else F.when(when, p)

    def at(kind: str, key: str) -> Column:
        return F.try_element_at(kind, lit(key))

    usable_any = reduce(lambda a, x: a | V.usable(F.coalesce(at("axes", x.key), V.unknown())),
                        [x for x in axes if x.better], lit(False))
    disputed_any = reduce(lambda a, x: a | V.has_status(at("axes", x.key), V.DISPUTED), axes, lit(False))
    items = [
        pair("classified", "records"),
        pair("classified", "match", match),
        pair("classified", "other", F.coalesce(F.col("category.text") == "other", lit(False))),
        pair("classified", "no decision", ~V.known(F.col("category"))),
        *[pair(f"axis {x.key}", F.coalesce(at("axes", x.key)["status"], lit("absent")), match) for x in axes],
        *[pair("declared" if c.adverse else "claimed", c.key,
               match & V.has_status(at("claims", c.key), V.TRUSTED)) for c in claims],
        pair("listings", "with a family", match & F.col("offer").isNotNull()),
        pair("listings", "with a trusted axis", match & usable_any),
        pair("listings", "with a disputed axis", match & disputed_any),
    ]
    own = variation.own_offer(order)
    shown = match & variation.poolable()

    def emitted(kind: str, a: Column, b: Column, when: Column) -> Column:
        return F.when(when, F.struct(lit(kind).alias("kind"), a.alias("a"), b.alias("b")))

    rows = F.array(*[F.when(i.isNotNull(), F.struct(lit("count").alias("kind"), i["metric"].alias("a"), i["key"].alias("b")))
                     for i in items],
                   emitted("listing", own["member"], own["offer"], match),
                   emitted("matrix", variation.matrix_digest(), lit(None).cast("string"), shown))
    claim = F.col(order)
    first = F.when(F.col("i.kind") == "matrix", F.col("variation"))
    counted = unfold(cards, F.array_compact(rows), "i", claim.alias("claim"), "variation").select(
        "i.*", "claim", first.alias("variation")).groupBy("kind", "a", "b").agg(
        F.count(lit(1)).alias("n"), F.min("claim").alias("claim"), F.first("variation").alias("variation"))
    # A matrix becomes a row per member; other rows stay.
    parts = F.when(F.col("kind") == "matrix", F.transform(variation.member_offers(F.col("variation")), lambda m: F.struct(
        lit("member").alias("kind"), m["member"].alias("a"), m["offer"].alias("b")))).otherwise(
        F.array(F.struct("kind", "a", "b")))
    placed = unfold(counted, parts, "p", "n", "claim").select("p.*", "n", "claim")
    taken = F.when(F.col("kind") == "member", F.struct("claim", "b"))
    pooled = F.min(taken).over(Window.partitionBy("a"))["b"]
    placed = placed.withColumn("pooled", pooled).where("kind <> 'member'")
    listing = F.col("kind") == "listing"
    totals = placed.select(F.when(listing, lit("offers")).otherwise(F.col("a")).alias("metric"), F.when(listing, F.coalesce(
        "pooled", "b")).otherwise(F.col("b")).alias("key"), "n", "kind").groupBy("kind", "metric", "key").agg(F.sum("n").alias("n"))

    def count(key: str, n: Column) -> Column:
        return F.struct(lit("offers").alias("metric"), lit(key).alias("key"), n.cast("bigint").alias("n"))

    result = F.when(F.col("kind") == "listing", F.array(count("offers", lit(1)), count("folded variants", F.col("n") - 1))) \
        .otherwise(F.array(F.struct("metric", "key", "n")))
    none = cards.sparkSession.range(1).select(F.explode(F.array(count("offers", lit(0)), count("folded variants", lit(0)))).alias("o"))
    return unfold(totals, result, "o").unionByName(none).groupBy("o.metric", "o.key").agg(F.sum("o.n").alias("n"))


def shown_axes(cards: DataFrame, category) -> DataFrame:
    """One row per matching card and axis: the value in words, as the axis words it, with its status."""
    rows = F.array(*[F.struct(
        lit(x.key).alias("key"), lit(x.label).alias("label"), x.shown(F.try_element_at("axes", lit(x.key))).alias("shown"),
        F.coalesce(F.try_element_at("axes", lit(x.key))["status"], lit("absent")).alias("status")) for x in category.axes])
    return unfold(matching(cards), rows, "x", "asin").select("asin", "x.*")


def sections(cards: DataFrame, category) -> DataFrame:
    """One row per axis or claim of a card, filed under the section it is shown in."""
    rows = []
    for x in category.axes:
        v = F.try_element_at("axes", lit(x.key))
        rows.append(F.struct(
            F.when(V.usable(F.coalesce(v, V.unknown())), lit("axis")).otherwise(lit("not known")).alias("section"),
            lit(x.key).alias("key"), F.coalesce(v["status"], lit("absent")).alias("status"),
            nth(v["evidence"], 0)["quote"].alias("quote")))
    listed = F.array(*rows)
    known = [c.key for c in category.claims]
    adverse = [c.key for c in category.claims if c.adverse] or [""]
    claimed = F.transform(F.map_entries("claims"), lambda e: F.struct(
        cases((V.has_status(e["value"], V.NOT_CLAIMED), lit("not claimed")),
              (~e["key"].isin(*known), lit("found by a check")),
              (e["key"].isin(*adverse) | V.has_status(e["value"], V.DISPUTED), lit("against it")),
              otherwise=lit("claims")).alias("section"),
        e["key"].alias("key"), e["value"]["status"].alias("status"),
        nth(e["value"]["evidence"], 0)["quote"].alias("quote")))
    return unfold(matching(cards), F.concat(listed, F.coalesce(claimed, F.array())), "s", "asin").select("asin", "s.*")


def facts(cards: DataFrame) -> DataFrame:
    """Axes and claims of every card as a long table."""
    def of(kind: str) -> Column:
        return F.transform(F.map_entries(kind), lambda e: F.struct(
            lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("v")))

    return unfold(cards, F.concat(of("axes"), of("claims")), "f", "asin", "category_key").select("asin", "category_key", "f.kind", "f.key", "f.v")


def card_json(cards: DataFrame, name: str = "json") -> DataFrame:
    """One JSON line per card, with the category's own parts where it has any."""
    extra = [c for c in ("drying", "suitability", "grain_type", "cultivar", "declaration_conflict",
                         "review_signals", "external_test", "score") if c in cards.columns]
    return cards.select("asin", F.to_json(F.struct(
        "category_key", "asin", "title", "brand", F.col("product_url").alias("url"),
        F.col("search_query").alias("query"), "category", "axes", "claims", *extra)).alias(name))
