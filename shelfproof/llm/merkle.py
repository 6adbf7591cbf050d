"""Merkle manifest of a table: a content-addressed DAG, and proofs by descending it.

Leaves are SHA-256 digests of rows, in order of id within their group.  Every
``RUN`` consecutive nodes become the digest of their hex digests, level by level, until one is
left: the group's subroot.  Subroots, in order of their group, are made into the root the same
way.

1. A leaf takes its place in its group from one global order by ranges (``numbered``), in
   which no task sees more than its range.
2. Each level is one aggregate by run that writes *records*: digest to children.  The
   record of a run of leaves holds what belongs to each leaf too.
3. Requests go down from the root.  The record of a digest is looked up; the digit of
   the rank at that level selects a child, and the children not selected are one
   segment of the path.  Leaves that share the way so far share one request, which
   parts at the record, so a level has as many requests as nodes and the requests of
   n leaves cost n / ``RUN`` rows at the last shuffle.  Beside the digest a
   request names the record's place, so that equal content at many places is no hot key.
4. Segments, collected from the root down, are reversed: the siblings from the leaf up.
   Folding the leaf that is shown with them gives the root again, or shows that it was changed.

NULL groups are one group, the first; NULL ids come first in theirs; rows of one id are
ordered by their leaf, and rows that repeat are leaves each.  A NULL field is encoded as ``-``,
an empty one as ``0:``.  Texts of any length become one digest and do not move.  Other columns of the
input are not looked at, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfproof.llm.common import numbered, stored, with_keyed

RUN = 8


def encoded(value: Column) -> Column:
    """``-`` for NULL, otherwise byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """Digest of the hex texts of an array of digests."""
    return F.unhex(F.sha2(F.concat_ws("", F.transform(digests, text_of)), 256))


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while RUN ** levels < n:
        levels += 1
    return levels


def records(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Records of each level above ``nodes`` (``g``, ``n`` nodes in all, ``idx``, ``digest``, further columns).

    ``children`` holds the digests, and on the first level what further columns of the nodes hold.
    """
    found = []
    for level in range(1, most + 1):
        inside = [c for c in nodes.columns if c not in ("g", "n", "children")] if level == 1 else ["idx", "digest"]
        runs = nodes.where(F.col("n") > RUN ** (level - 1)).groupBy("g", "n", F.floor(F.col("idx") / RUN).alias("run")).agg(
            F.sort_array(F.collect_list(F.struct(*inside))).alias("children"))
        nodes = stored(runs.select("g", "n", F.col("run").alias("idx"), joined(F.col("children.digest")).alias("digest"),
                                   "children"), f"records{level}")
        found.append(nodes)
    return found


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``g``, ``digest`` and ``height`` of each group's last node."""
    found = nodes.where(F.col("n") == 1).select("g", "digest", F.lit(0).alias("height"))
    for level, made in enumerate(levels, 1):
        found = found.union(made.where((F.col("n") > RUN ** (level - 1)) & (F.col("n") <= RUN ** level))
                            .select("g", "digest", F.lit(level).alias("height")))
    return found


def descended(requests: DataFrame, made: DataFrame, carried: list[str]) -> DataFrame:
    """Requests for the children of the records that ``requests`` (``g``, ``idx``, ``digest``, ``path``) name."""
    r, m = requests.alias("r"), made.alias("m")
    at = (F.col("r.digest") == F.col("m.digest")) & (F.col("r.g") == F.col("m.g")) & (F.col("r.idx") == F.col("m.idx"))
    parted = r.join(m, at).select("r.g", "r.path", *[f"r.{c}" for c in carried], "m.children",
                                  F.posexplode("m.children").alias("digit", "child"))
    others = F.filter(F.col("children.digest"), lambda _, i: i != F.col("digit"))
    step = F.array(F.struct("digit", others.alias("others")))
    return parted.withColumn("path", F.concat("path", step)).drop("children", "digit").select(
        "g", "path", *carried, "child.*")


NO_PATH = "CAST(array() AS array<struct<digit:int,others:array<binary>>>)"


def manifest(rows: DataFrame, group: Column, order: Column, digest: Column, shown: Column) -> DataFrame:
    """Each row's ``id`` (its ``order``), ``leaf``, ``subroot``, ``root``, ``proof`` path and ``shown`` leaf.

    ``proof`` lists, from the leaf up, the place of the node in its run (``digit``) and the run's ``others``.
    """
    base = stored(rows.select(group.alias("group"), order.alias("id"), digest.alias("digest"), shown.alias("shown"),
                              F.monotonically_increasing_id().alias("row")), "leaves")
    kind = base.schema["id"].dataType.simpleString()
    all_ = numbered(base, [F.col(c) for c in ("group", "id", "digest", "row")], "place")
    sizes = stored(all_.groupBy("group").agg(F.count("*").alias("n"), F.min("place").alias("first")), "sizes")
    sizes = stored(numbered(sizes, [F.col("group")], "g"), "groups")
    n_groups, most = sizes.agg(F.count("*"), F.max("n")).first()
    if not n_groups:
        return base.sparkSession.createDataFrame([], (
            f"id {kind}, leaf binary, subroot binary, root binary, "
            "proof array<struct<digit:int,others:array<binary>>>, shown binary"))
    nodes = stored(with_keyed(all_, sizes.select("group", "n", "first", "g"), "group", n_groups, F.col("row")).select(
        "g", "n", (F.col("place") - F.col("first")).alias("idx"), "digest", "id", "shown"), "nodes")
    levels = records(nodes, height(most))
    subroots = stored(tops(nodes, levels), "subroots")
    over = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).alias("n"), F.col("g").alias("idx"), "digest")
    upper = records(over, height(n_groups))
    root = (upper[-1] if upper else over).select("digest").first()[0]  # one row

    asked = (upper[-1] if upper else over).select("g", "idx", "digest", F.expr(NO_PATH).alias("path"))
    for made in reversed(upper):
        asked = descended(asked, made, [])
    asked = asked.select(F.col("idx").alias("_g"), F.col("digest").alias("_top"), "path")
    asked = stored(asked.join(subroots, (F.col("_g") == F.col("g")) & (F.col("_top") == F.col("digest"))).select(
        "g", F.lit(0).cast("long").alias("idx"), "digest", "path", F.col("digest").alias("subroot"), "height"), "asked")
    now = None
    for level in range(len(levels), 0, -1):
        start = asked.where(F.col("height") == level).drop("height")
        now = start if now is None else now.unionByName(start)
        now = descended(now, levels[level - 1], ["subroot"])
    lone = asked.where(F.col("height") == 0).join(nodes.where(F.col("n") == 1).select("g", "id", "shown"), "g").select(
        "g", "path", "subroot", "idx", "digest", "id", "shown")
    now = lone if now is None else now.unionByName(lone)
    return now.select("id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"),
                      F.reverse("path").alias("proof"), "shown")


def siblings(proof: Column) -> Column:
    """Digests of a proof, from the leaf up, each level from left to right."""
    return F.flatten(F.transform(proof, lambda s: s.others))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    def up(node: Column, step: Column) -> Column:
        run = F.concat(F.slice(step.others, F.lit(1), step.digit), F.array(node),
                       F.slice(step.others, step.digit + 1, F.lit(RUN)))
        return joined(run)

    return F.aggregate(proof, start, up)
