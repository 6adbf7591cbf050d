"""Threshold-scaled sketches of documents in built-in functions only.

A text's fingerprint keeps the hash of every shingle of ``WIDTH`` words that lies below a fixed
fraction of the hash range; where none does, as in a text of a few words, the smallest one.  A fingerprint of two texts together is the union of
theirs, and the share of one fingerprint's hashes that another has estimates how much of the one text the
other contains, however unequal they are.

The fingerprint is a string: the kept hashes, ten hexadecimal digits each, in order.  A text
of fewer than ``WIDTH`` words is one shingle, a text without words none; NULL is empty.
``likeness`` is the share that the smaller fingerprint has in common with the larger one, 1 if
both are equal and 0 if only one is empty.  Only texts without words have an empty fingerprint, and these are alike.

``with_next`` finds each document's successor in descending order of ids (whole numbers): ids are cut into buckets
at approximate quantiles, each bucket's first row is also given to the bucket before it, and a
window within each bucket does the rest, so texts are moved once.  Rows that repeat an id are ordered by a hash of their texts; NULL ids
come last.  A single document is its own successor.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: One hash in FRACTION is kept.
FRACTION = 4
#: Bits of a kept hash that the fingerprint shows.
SHOWN = 40
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def kept(hashes: Column, width: int = WIDTH, fraction: int = FRACTION) -> Column:
    """Kept shingle hashes, in order and once each, from the hashes of a text's words."""
    n = F.size(hashes)
    places = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    shingle = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    top = F.transform(F.when(n > 0, shingle).otherwise(F.array().cast("array<bigint>")),
                      lambda h: F.shiftrightunsigned(h, 64 - SHOWN))
    low = lambda hs: F.filter(hs, lambda h: h < F.lit((1 << SHOWN) // fraction))
    some = once(top, lambda hs: once(low(hs), lambda found: F.when(F.size(found) > 0, found).otherwise(
        F.array_compact(F.array(F.array_min(hs))))))
    return F.array_sort(F.array_distinct(some))


def once(value: Column, of) -> Column:
    """``of(value)`` with ``value`` worked out once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def sketch(text: Column) -> Column:
    return once(F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)), lambda h: kept(h))


def shown(hashes: Column) -> Column:
    return F.lower(F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.hex(h), SHOWN // 4, "0"))))


def likeness(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / least)


def with_next(docs: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: the text of the next row in descending order of ids, after the last that of the first."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)])).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)  # fewer than the buckets
    wide = math.isqrt(len(cuts)) + 1
    fine, coarse = (F.array(*map(F.lit, c)).cast("array<long>") for c in (cuts, cuts[wide - 1::wide]))
    above = lambda some: F.size(F.filter(some, lambda c: c > F.col(id_col)))
    whole = above(coarse) * wide
    bucket = F.when(F.col(id_col).isNull(), F.lit(len(cuts) + 1)).otherwise(
        whole + above(F.slice(fine, whole + 1, F.lit(wide)))).cast("int")
    rows = docs.withColumns({"_tie": F.xxhash64(text_col), "_bucket": bucket})
    firsts = rows.groupBy("_bucket").agg(F.max(F.struct(
        F.col(id_col).isNotNull().alias("there"), F.col(id_col).alias("id"), F.bitwise_not("_tie").alias("tie"))).alias("_f"))
    # A row a bucket: the bucket before it also gets its first row; the very first row goes to the last bucket.
    to = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy()))
    firsts = firsts.select(to.alias("_to"), F.col("_f.id").alias("_id"), F.bitwise_not(F.col("_f.tie")).alias("_first"))
    guests = rows.join(F.broadcast(firsts), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_first")))
    guests = guests.withColumn("_bucket", F.col("_to")).select(*rows.columns, F.lit(True).alias("_guest"))
    place = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_col).desc_nulls_last(), "_tie")
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests)
    return both.withColumn(out, F.lead(text_col).over(place)).where(~F.col("_guest")).drop("_tie", "_bucket", "_guest")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses; see ``queries.op6_fingerprints``."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pair = with_next(own, "id", "text", "next")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    pair = pair.select("id", n.cast("long").alias("n_chars"), changed.alias("changed"), sketch(F.col("text")).alias("kept"),
                       sketch(F.col("next")).alias("kept_next"))
    pair = pair.withColumn("kept_edited", sketch(F.col("changed")))
    return pair.select(F.col("id").alias(id_col), "n_chars", F.sha2("changed", 256).alias("edited_sha256"),
                       shown(F.col("kept")).alias("fingerprint"), shown(F.col("kept_edited")).alias("edited_fingerprint"),
                       likeness(F.col("kept"), F.col("kept_edited")).alias("near_edited"),
                       likeness(F.col("kept"), F.col("kept_next")).alias("near_next"))
