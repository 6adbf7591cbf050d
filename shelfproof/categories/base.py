"""What a category declares.  Rules are data; the jobs that read them are generic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.functions.values import filled, lit
from shelfproof.functions import values as V
from shelfproof.functions.text import IU, matches
from shelfproof.operators import search as S
from shelfproof.operators.validate import Profile, validate

VALUE_MAP = T.MapType(T.StringType(), V.VALUE)


@dataclass(frozen=True)
class Axis:
    """One thing two products can be compared on."""

    key: str
    label: str
    better: str = ""
    tolerance: float = 0.0
    caveat: str = ""
    #: Words the value struct; by default its number and unit, or its text.
    render: Callable[[Column], Column] | None = None

    def shown(self, value: Column) -> Column:
        """A value struct as text, NULL where there is no value."""
        if self.render is not None:
            return F.when(V.present(value), self.render(value))
        unit = F.coalesce(F.concat(lit(" "), filled(value["unit"])), lit(""))
        return F.coalesce(F.concat(V.number_text(value["value"]), unit), value["text"])


@dataclass(frozen=True)
class Claim:
    """A statement to look for in the vendor's words; ``adverse`` counts against the product."""

    key: str
    label: str
    pattern: str
    adverse: bool = False
    fields: tuple | None = None


@dataclass(frozen=True)
class Category:
    key: str
    label: str
    profile: Profile
    axes: tuple[Axis, ...]
    claims: tuple[Claim, ...]
    #: Classification from the raw listing columns and ``_fields``.
    classify: Callable[[], Column]
    #: Projections that add ``axes``, ``claims`` and the category's own columns to
    #: validated listings, in order.
    fill: Callable[[], list[dict[str, Column]]]
    default_axis: str

    def axis(self, key: str) -> Axis:
        for axis in self.axes:
            if axis.key == key:
                return axis
        raise KeyError(f"{key}: not an axis of {self.label}; known: {[a.key for a in self.axes]}")

    def claim(self, key: str) -> Claim:
        for claim in self.claims:
            if claim.key == key:
                return claim
        raise KeyError(f"{key}: not a claim of {self.label}; known: {[c.key for c in self.claims]}")


REGISTRY: dict[str, Category] = {}


def register(category: Category) -> Category:
    REGISTRY[category.key] = category
    return category


def get(key: str) -> Category:
    if key not in REGISTRY:
        raise KeyError(f"{key}: unknown category; known: {sorted(REGISTRY)}")
    return REGISTRY[key]


def stated(fields: str, claim: Claim, limit: int = 2, **kw) -> Column:
    """A claim as a value: trusted with quotes, or not claimed (which is not "untrue")."""
    hits = S.search(fields, IU + claim.pattern, limit=limit, only=claim.fields, **kw)
    return V.let(hits, lambda h: F.when(F.size(h) > 0, V.value(
        1.0, status=V.TRUSTED, source=V.TEXT, evidence=h))
        .otherwise(V.value(0.0, status=V.NOT_CLAIMED, notes=["not stated anywhere on the page"])))


def value_map(entries: dict[str, Column]) -> Column:
    """A map of value structs without its NULL entries."""
    pairs = F.array(*[F.when(v.isNotNull(), F.struct(lit(k).alias("key"), v.cast(V.VALUE).alias("value")))
                      for k, v in entries.items()])
    return F.map_from_entries(F.array_compact(pairs)).cast(VALUE_MAP)


def is_match(category: Category) -> Column:
    return F.coalesce(F.col("category.text") == category.key, lit(False))


def evaluate(listings: DataFrame, category: Category) -> DataFrame:
    """Listings to cards.  Only accepted listings get axes and claims."""
    out = validate(listings.withColumn("_fields", S.text_fields()), category.profile)
    for columns in _passes(category.key):
        out = out.withColumns(columns)
    return out.drop("_fields", "_said", "_told", "_claims", "_parts", "_gaps")


@lru_cache(maxsize=None)
def _passes(key: str) -> list[dict[str, Column]]:
    """A category's projections, built once: columns are immutable."""
    category = get(key)
    empty = F.create_map().cast(VALUE_MAP)
    # Fields in which any claim may be stated: one pass over the texts, the single claims read only these.
    either = IU + "|".join(f"(?:{c.pattern})" for c in category.claims)
    said = F.filter("_fields", lambda f: matches(f["text"], either))
    return [{"category": category.classify(), "category_key": lit(key), "_said": said}, *category.fill(),
            {name: F.when(is_match(category), F.col(name)).otherwise(empty) for name in ("axes", "claims")}]


def found(v: Column) -> Column:
    """A claim or signal that was established and not disputed."""
    return F.coalesce((v["value"] == 1.0) & (v["status"] != V.DISPUTED), lit(False))


def head(text: Column, size: int = 160) -> Column:
    return F.substring(text, 1, size)
