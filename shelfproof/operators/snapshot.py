"""Field-by-field difference of two snapshots of the same records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.functions.values import let, lit, unfold

ENTRIES = "array<struct<path: string, value: string>>"


def _entry(path: Column, value: Column) -> Column:
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def flatten(c: Column, dtype: T.DataType, path: Column) -> Column:
    """A nested column as (path, value) entries; an array also states its length.

    The expression follows the schema, so the work per row is one pass.
    """
    none = F.expr(f"cast(array() as {ENTRIES})")
    if isinstance(dtype, T.StructType):
        parts = [flatten(c[f.name], f.dataType, F.concat(path, lit("."), lit(f.name))) for f in dtype.fields]
        out = F.concat(*parts)
    elif isinstance(dtype, T.ArrayType):
        out = F.concat(_entry(F.concat(path, lit("[]")), F.size(c)), F.flatten(F.transform(
            c, lambda x, i: flatten(x, dtype.elementType, F.concat(
                path, lit("["), i.cast("string"), lit("]"))))))
    elif isinstance(dtype, T.MapType):
        out = F.flatten(F.transform(F.map_entries(c), lambda e: flatten(
            e["value"], dtype.valueType, F.concat(path, lit("."), e["key"]))))
    else:
        out = _entry(path, c)
    return F.when(c.isNotNull(), out).otherwise(none)


def entries(columns: list[T.StructField], side: str | None = None) -> Column:
    at = lambda name: F.col(f"{side}.{name}" if side else name)
    return F.concat(*[flatten(at(f.name), f.dataType, lit(f.name)) for f in columns])


def difference(expected: DataFrame, actual: DataFrame, key: str = "asin") -> DataFrame:
    """(key, path, expected, actual) of every field that differs.

    Rows are compared by digest in one outer join; only rows that differ are
    taken apart, on the joined row itself, so there is no second shuffle.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != key]
        return df.select(F.col(key).alias(f"_{name}_key"), F.struct(*fields).alias(name),
                         F.sha2(F.to_json(F.struct(*fields)), 256).alias(f"_{name}_digest"))

    e, a = side(expected, "e"), side(actual, "a")
    both = e.join(a, F.col("_e_key") == F.col("_a_key"), "full_outer") \
            .where(~F.col("_e_digest").eqNullSafe(F.col("_a_digest")))
    want = entries([f for f in expected.schema.fields if f.name != key], "e")
    got = entries([f for f in actual.schema.fields if f.name != key], "a")

    def compare(m: Column) -> Column:
        paths = F.array_union(F.map_keys(m["e"]), F.map_keys(m["a"]))
        rows = F.transform(paths, lambda p: F.struct(
            p.alias("path"), F.try_element_at(m["e"], p).alias("expected"), F.try_element_at(m["a"], p).alias("actual")))
        return F.filter(rows, lambda r: ~r["expected"].eqNullSafe(r["actual"]))

    maps = F.struct(F.map_from_entries(want).alias("e"), F.map_from_entries(got).alias("a"))
    return unfold(both, let(maps, compare), "d", F.coalesce("_e_key", "_a_key").alias(key)).select(key, "d.*")
