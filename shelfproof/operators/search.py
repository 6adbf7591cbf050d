"""Attributed search over the vendor's own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfproof.functions.values import expr, filled, lit, sql_literal, unfold
from shelfproof.functions import spans
from shelfproof.functions import values as V
from shelfproof.functions.text import matches

#: Fields in which a listing speaks about itself alone.
SELF_FIELDS = ("food.ingredients", "title", "raw_tables")

TEXT_FIELDS = "array<struct<field: string, base: string, text: string>>"


def text_fields() -> Column:
    """Every free text of a listing, most authoritative first."""
    def one(base: str, text: Column, field=None) -> Column:
        return F.struct(V.col(field if field is not None else base).cast("string").alias("field"),
                        lit(base).alias("base"), text.alias("text"))

    def each(base: str, items: Column, text, label) -> Column:
        return F.coalesce(F.transform(items, lambda x, i: one(base, text(x), label(x, i))),
                          F.array()).cast(TEXT_FIELDS)

    def indexed(base: str):
        return lambda x, i: F.format_string(base + "[%d]", i)

    food, content = F.col("food"), F.col("content")
    fields = F.concat(
        F.array(one("food.ingredients", food["ingredients"]["text"]),
                one("title", F.col("title"))).cast(TEXT_FIELDS),
        each("content.feature_bullets", content["feature_bullets"], lambda b: b,
             indexed("content.feature_bullets")),
        F.array(one("content.description", content["description"])).cast(TEXT_FIELDS),
        each("raw_tables", F.map_entries("raw_tables"),
             lambda e: F.concat(e["key"], lit(": "), e["value"]),
             lambda e, i: F.concat(lit("raw_tables."), e["key"])),
        each("content.important_information", content["important_information"],
             lambda s: F.concat_ws(": ", filled(s["heading"]), s["text"]),
             indexed("content.important_information")),
        F.array(one("content.aplus", content["aplus"]["text"])).cast(TEXT_FIELDS))
    return F.filter(fields, lambda f: F.coalesce(f["text"] != "", lit(False)))


def _inside(only) -> str:
    return "(" + " or ".join(f"q_field.base = {sql_literal(o)} or startswith(q_field.base, {sql_literal(o + '.')})" for o in only) + ")"


def _scope(scope: str, only) -> str:
    if scope not in ("self", "page"):
        raise ValueError(f"unknown search scope: {scope!r}")
    tests = [_inside(SELF_FIELDS)] if scope == "self" else []
    if only is not None:
        tests.append(_inside(only))
    return " and ".join([*tests, ""])


def search(fields: str, pattern: str, limit: int = 3, only=None, scope: str = "page",
           affirmative: bool = False, exclude: str | None = None) -> Column:
    """Quotes for a pattern, one per field, source order, at most ``limit``.

    ``fields`` names a ``text_fields`` column.  Fields out of scope are dropped
    before any pattern runs on them.
    """
    if limit <= 0:
        return expr(V.NO_EVIDENCE)
    hits = (f"transform(filter({fields}, q_field -> {_scope(scope, only)}{spans.matches('q_field.text', pattern)}), q_field ->"
            f" named_struct('field', q_field.field, 'quote', {spans.quoted_match('q_field.text', pattern, affirmative, exclude)}))")
    return expr(f"coalesce(slice(filter({hits}, q_found -> q_found.quote is not null), 1, {limit}), {V.NO_EVIDENCE})")


def states(fields: str, pattern: str, only=None) -> Column:
    """Does any field match?  The search without its quotes."""
    return expr(f"coalesce(exists({fields}, q_field -> {_scope('page', only)}{spans.matches('q_field.text', pattern)}), false)")


def claim_hits(texts: DataFrame, claims: list[tuple[str, str]], key: str, limit: int = 3,
               order: str = "ord") -> DataFrame:
    """Claim scan over a long table (key, ord, field, text): one row per accepted hit.

    One pass over the texts: a single alternation drops rows no claim can match,
    the rest expand only into the claims they do match.  The ``limit`` per (key,
    claim) is a limited rank, which Spark applies on the map side first, so a
    key with very many texts is cut before the shuffle.
    """
    from pyspark.sql import Window

    any_claim = "(?iU)" + "|".join(f"(?:{p})" for _, p in claims)
    hits = F.array_compact(F.array(*[
        F.when(matches(F.col("text"), "(?iU)" + p), F.struct(
            lit(k).alias("claim"),
            expr(spans.quoted_match("text", "(?iU)" + p)).alias("quote"))) for k, p in claims]))
    found = (unfold(texts.where(matches(F.col("text"), any_claim)), hits, "h", key, order, "field")
             .select(key, order, "field", "h.claim", "h.quote"))
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy(key, "claim").orderBy(order)))
    return ranked.where(F.col("rank") <= limit)
