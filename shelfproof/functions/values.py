"""The value struct: a number or text, where it came from, what it survived.

Every builder returns a column of the same struct type, so branches of a
``when`` chain line up without casts at the call site.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The status and source vocabularies.
TRUSTED = "trusted"
DISPUTED = "disputed"
UNVERIFIED = "unverified"
UNKNOWN = "unknown"
NOT_CLAIMED = "not_claimed"
STATUSES = (TRUSTED, DISPUTED, UNVERIFIED, UNKNOWN, NOT_CLAIMED)

STRUCTURED = "structured"
ATTRIBUTES = "attributes"
TEXT = "text"
PUBLISHED = "published"
DERIVED = "derived"
SOURCES = (STRUCTURED, ATTRIBUTES, TEXT, PUBLISHED, DERIVED)

EVIDENCE = T.StructType([T.StructField("field", T.StringType()),
                         T.StructField("quote", T.StringType())])
EVIDENCE_LIST = T.ArrayType(EVIDENCE)
STRINGS = T.ArrayType(T.StringType())
VALUE = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("notes", STRINGS),
    T.StructField("evidence", EVIDENCE_LIST),
    T.StructField("flags", STRINGS),
])


@lru_cache(maxsize=None, typed=True)
def lit(x) -> Column:
    """A literal column, built once per process: columns are immutable."""
    return F.lit(x)


@lru_cache(maxsize=None)
def expr(sql: str) -> Column:
    """A constant SQL expression, built once per process."""
    return F.expr(sql)


def col(x) -> Column:
    """A column as it is; anything else as a literal."""
    return x if isinstance(x, Column) else lit(x)


def nth(items: Column, place: int) -> Column:
    """The item at a place from 0, NULL where there is none.

    ``get`` asks its array for its type at every row, through all that the array is made of; this asks once.
    """
    return F.try_element_at(items, lit(place + 1))


def let(x: Column, body) -> Column:
    """Evaluate ``x`` once and use it several times inside ``body``."""
    return nth(F.transform(F.array(x), body), 0)


def filled(c: Column) -> Column:
    """``c`` with NULL in place of the empty string; unlike ``nullif`` within a lambda, it evaluates ``c`` once."""
    return let(c, lambda t: F.when(t != lit(""), t))


def sql_literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else repr(x)


def constant_map(table: dict) -> Column:
    """A small constant table as a map.

    It is one constant expression whatever the table's size, so that plans with many lookups stay small; the optimiser
    turns it into a literal.
    """
    return expr(f"from_json({sql_literal(json.dumps(table, ensure_ascii=False))}, 'map<string, {_kind(table)}>')")


def _kind(table: dict) -> str:
    kinds = {type(v) for v in table.values()}
    return "string" if str in kinds else "double" if float in kinds else "int"


#: Entries of a table that are looked through one by one; of more, only those whose key has the same CRC in its low bits.
FEW = 8


def lookup(table: dict, key: Column) -> Column:
    """The value of ``key`` in a small constant table, else NULL."""
    if len(table) <= FEW:
        return F.try_element_at(constant_map(table), key)
    buckets: list[dict] = [{} for _ in range(1 << (len(table) // 2).bit_length())]
    for k, v in table.items():
        buckets[zlib.crc32(k.encode()) & (len(buckets) - 1)][k] = v
    maps = expr(f"from_json({sql_literal(json.dumps(buckets, ensure_ascii=False))}, 'array<map<string, {_kind(table)}>>')")
    return let(key, lambda k: F.try_element_at(
        F.get(maps, F.crc32(k.cast("binary")).bitwiseAND(lit(len(buckets) - 1)).cast("int")), k))


NO_STRINGS = "cast(array() as array<string>)"
NO_EVIDENCE = "cast(array() as array<struct<field: string, quote: string>>)"
VALUE_DDL = ("struct<value: double, text: string, status: string, source: string, unit: string,"
             " notes: array<string>, evidence: array<struct<field: string, quote: string>>,"
             " flags: array<string>>")


def named(**fields) -> Column:
    """A struct from keyword arguments."""
    return F.named_struct(*[x for name, c in fields.items() for x in (lit(name), col(c))])


def evidence(field, quote) -> Column:
    return named(field=field, quote=quote)


NO_NUMBER = "cast(null as double)"
NO_TEXT = "cast(null as string)"


def value(number=None, *, text=None, status=UNKNOWN, unit="", source="",
          notes=(), evidence=(), flags=()) -> Column:
    """One value struct.  List arguments take items or a ready array column."""
    def listed(items, empty: str) -> Column:
        if isinstance(items, Column):
            return items
        return F.array(*[col(i) for i in items]) if items else expr(empty)

    return named(
        value=expr(NO_NUMBER) if number is None else col(number).cast("double"),
        text=expr(NO_TEXT) if text is None else text, status=status, source=source, unit=unit,
        notes=listed(notes, NO_STRINGS), evidence=listed(evidence, NO_EVIDENCE), flags=listed(flags, NO_STRINGS))


def unknown(*notes, **kw) -> Column:
    return value(None, status=UNKNOWN, notes=notes, **kw)


def present(v: Column) -> Column:
    return v["value"].isNotNull() | v["text"].isNotNull()


def usable(v: Column) -> Column:
    """Trusted and not empty: the only values a ranking may read."""
    return F.coalesce((v["status"] == TRUSTED) & present(v), lit(False))


def known(v: Column) -> Column:
    return F.coalesce((v["status"] != UNKNOWN) & present(v), lit(False))


def has_status(v: Column, status: str) -> Column:
    return F.coalesce(v["status"] == status, lit(False))


def plus(items: Column, *more) -> Column:
    """Append items to an array, skipping NULL ones."""
    return F.concat(items, F.array_compact(F.array(*[col(m) for m in more])))


def updated(v: Column, **changes) -> Column:
    """A value with some fields replaced; each change is a function of the bound value.

    The value is bound once, so a deep chain of updates stays linear in size.
    """
    return let(v, lambda x: reduce(lambda acc, f: acc.withField(f, changes[f](x)), changes, x))


def noted(v: Column, *notes) -> Column:
    return updated(v, notes=lambda x: plus(x["notes"], *notes))


def flagged(v: Column, flag: str, *notes) -> Column:
    return updated(v, flags=lambda x: F.array_union(x["flags"], F.array(lit(flag))),
                   notes=lambda x: plus(x["notes"], *notes))


def disputed(v: Column, note, more_evidence: Column | None = None) -> Column:
    """Keep the value, mark it disputed and say why."""
    return updated(
        v, status=lambda x: lit(DISPUTED), notes=lambda x: plus(x["notes"], note),
        evidence=lambda x: x["evidence"] if more_evidence is None else F.concat(x["evidence"], more_evidence))


def trusted(v: Column, *notes, more_evidence: Column | None = None) -> Column:
    return updated(
        v, status=lambda x: lit(TRUSTED), notes=lambda x: plus(x["notes"], *notes) if notes else x["notes"],
        evidence=lambda x: x["evidence"] if more_evidence is None else F.concat(x["evidence"], more_evidence))


def unfold(df: DataFrame, items: Column, name: str, *keep) -> DataFrame:
    """One row per array item, none for an empty array.

    A plain ``explode`` infers a filter on the array's size, which computes the
    array a second time below the generator; this filters the items instead.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def cases(*branches, otherwise: Column) -> Column:
    """First branch whose condition holds: ``cases((cond, col), ..., otherwise=col)``."""
    chain = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))
    return chain.otherwise(otherwise)


def number_text(x: Column) -> Column:
    """Six significant digits without trailing zeros, for notes and quotes."""
    size = F.abs(x)
    shown = cases(
        (size < 1, F.format_string("%.6f", x)),
        (size < 10, F.format_string("%.5f", x)),
        (size < 100, F.format_string("%.4f", x)),
        (size < 1_000, F.format_string("%.3f", x)),
        (size < 10_000, F.format_string("%.2f", x)),
        (size < 100_000, F.format_string("%.1f", x)),
        otherwise=F.format_string("%.0f", x))
    return F.when(x.isNotNull(), F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", ""))
                  .otherwise(shown))
