"""Merge, search, offers, ranking, comparison, snapshots: against brute force on small tables."""

from __future__ import annotations

import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfproof.functions import spans
from shelfproof.functions.values import expr
from shelfproof.operators import merge, nutrition, ranking, search, snapshot, variation
from shelfproof.sources import feeds


# --- merge ------------------------------------------------------------------------

def feed(tmp_path, name, records, zipped=False):
    path = tmp_path / (name + (".jsonl.gz" if zipped else ".jsonl"))
    text = "\n\n".join(json.dumps(r) for r in records) + "\n\n"
    with (gzip.open(path, "wt", encoding="utf-8") if zipped else open(path, "w", encoding="utf-8")) as fh:
        fh.write(text)
    return str(path)


def test_the_freshest_capture_wins(spark, tmp_path):
    old = feed(tmp_path, "b_old", [
        dict(asin="A", title="old", fetched_at="2026-09-14T10:00:00+00:00"), dict(asin="B", title="only"),
        dict(title="no id"), dict(asin="T", title="first", fetched_at="2026-09-14T10:00:00"),
        dict(asin="U", title="undated"), dict(asin="Z", title="late zone", fetched_at="2026-09-14T10:00:00+05:00")])
    new = feed(tmp_path, "a_new", [
        dict(asin="A", title="new", fetched_at="2026-09-15T10:00:00+00:00"), dict(title="no id"),
        dict(asin="T", title="second", fetched_at="2026-09-14T10:00:00+00:00"),
        dict(asin="U", title="dated", fetched_at="2020-01-01"), dict(asin="Z", title="utc", fetched_at="2026-09-14T06:00:00"),
        dict(asin="S", title="bad stamp", fetched_at="yesterday"), dict(asin="S", title="good", fetched_at="2026-01-01")], True)
    for paths in ([old, new], [new, old]):
        captures = merge.stamp_captures(feeds.read_feeds(spark, paths))
        got = merge.freshest(captures).select("asin", "title", "captures").collect()
        titles = {r.asin: r.title for r in got if r.asin}
        assert titles == {"A": "new", "B": "only", "T": "first" if paths[0] == old else "second", "U": "dated",
                          "Z": "utc", "S": "good"}
        assert sum(r.asin is None for r in got) == 2
        report = merge.provenance(captures).first()
        assert (report.records, report.feeds, report.superseded) == (8, 2, 5)


def test_output_keeps_first_seen_order(spark, tmp_path):
    path = feed(tmp_path, "f", [dict(asin=a, fetched_at=f"2026-01-0{i + 1}") for i, a in enumerate("CABCA")])
    rows = merge.freshest(merge.stamp_captures(feeds.read_feeds(spark, [path]))).orderBy("first_seen").collect()
    assert [r.asin for r in rows] == ["C", "A", "B"]


# --- search -------------------------------------------------------------------------

def python_first(text, pattern, affirmative, exclude):
    """The rule in plain Python, as an oracle for the spans."""
    banned = [m.span() for m in re.finditer(exclude, text, re.I)] if exclude else []
    strip = lambda p: re.compile(p.replace("(?iU)", ""), re.I)
    for m in re.finditer(pattern, text, re.I):
        if affirmative and (strip(spans.NEGATED_BEFORE).search(text[:m.start()])
                            or strip(spans.NEGATED_AFTER).search(text[m.end():])):
            continue
        if any(m.start() < hi and m.end() > lo for lo, hi in banned):
            continue
        return m.span()
    return None


def test_spans_equal_a_plain_scan(spark):
    rng = random.Random(7)
    words = ["nicht", "ohne", "Duft", "duftend", "frei", "-", "kein", "trocknet", "ein", "ÜBER", "no", "aroma", "."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for affirmative, exclude in ((False, None), (True, None), (True, "ohne duft"), (False, "kein aroma|trocknet ein")):
        pattern = r"\w*duft|aroma|trocknet"
        got = {r.i: (r.s.lo, r.s.hi) if r.s else None for r in df.select("i", expr(spans.first_span(
            "t", "(?iU)" + pattern, affirmative, exclude and "(?iU)" + exclude)).alias("s")).collect()}
        assert got == {i: python_first(t, pattern, affirmative, exclude) for i, t in enumerate(texts)}


def test_quotes_are_sentences_or_windows(spark):
    long = "x" * 200 + " Duft " + "y" * 200
    texts = ["Erster Satz. Der Reis hat Duft! Danach.", "Duft", long, "a | Duft hier"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.q for r in df.select("i", expr(spans.quoted_match("t", "(?iU)duft")).alias("q")).orderBy("i").collect()]
    assert got[0] == "…Der Reis hat Duft!…" and got[1] == "Duft" and got[3].endswith("Duft hier")
    assert got[2].startswith("…x") and got[2].endswith("y…") and len(got[2]) == 186


def test_scope_fields_and_limits(listings):
    df = listings([dict(asin="A", title="Duft Reis", raw_tables={"Sorte": "Duft"}, content=dict(
        feature_bullets=["viel Duft", "Duft", "kein Duft"], description="Duft"), food=dict(ingredients=dict(text="Duftreis")))])
    df = df.withColumn("f", search.text_fields())
    pick = lambda **kw: [e.field for e in df.select(search.search("f", "(?iU)duft", **kw).alias("h")).first().h]
    assert pick(limit=9) == ["food.ingredients", "title", "content.feature_bullets[0]", "content.feature_bullets[1]",
                             "content.feature_bullets[2]", "content.description", "raw_tables.Sorte"]
    assert pick() == ["food.ingredients", "title", "content.feature_bullets[0]"]
    assert pick(limit=9, scope="self") == ["food.ingredients", "title", "raw_tables.Sorte"]
    assert pick(limit=9, only=("content",), affirmative=True) == [
        "content.feature_bullets[0]", "content.feature_bullets[1]", "content.description"]
    assert pick(limit=0) == []
    with pytest.raises(ValueError):
        search.search("f", "x", scope="shop")


# --- offers and ranking ------------------------------------------------------------------

def matrix(parent=None, dims=("flavor_name", "size_name"), **members):
    return dict(dimensions=list(dims), values_by_asin={k: list(v) for k, v in members.items()}, parent_asin=parent)


def test_offers_fold_packs_but_not_flavours(listings):
    df = listings([
        dict(asin="A", variation=matrix("P", A=("Penne", "500 g"), B=("Penne, 6x500g", "3 kg"), C=("Fusilli", "500 g"))),
        dict(asin="B"), dict(asin="C", variation=matrix("Q", C=("Other", "x"))), dict(asin="D"),
        dict(asin="E", variation=matrix(None, E=("a", "b"))), dict(title="no id"), dict(title="no id"),
        dict(asin="F", variation=matrix(None, ("size_name",), F=("1 kg",), G=("2 kg",))),
        dict(asin="H", variation=matrix("P", ("size_name",), H=("1", "2")))])
    got = {r.ord: r.offer_id for r in variation.with_offers(df).select("ord", "offer_id").collect()}
    assert got[0] == got[1] == '{"family":"P","signature":["penne"]}'
    assert got[2] == '{"family":"P","signature":["fusilli"]}'
    assert got[7] == '{"family":"set:F,G","signature":[]}' and got[8] == '{"family":"P","signature":[]}'
    assert len({got[i] for i in (3, 4, 5, 6)}) == 4
    sizes = variation.offer_sizes(variation.with_offers(df)).first()
    assert sizes.listings == 2


def test_ranged_numbers_equal_a_window(spark):
    """One key holds most rows: the ranged plan must give the same numbers as a window."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 20)}", rng.randint(0, 5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    want = {}
    for k in {r[0] for r in rows}:
        for n, (_, i) in enumerate(sorted((v, i) for kk, v, i in rows if kk == k), 1):
            want[i] = n
    got = {r.i: r["rank"] for r in ranking.numbered(df, ["k"], ["v", "i"]).collect()}
    assert got == want


def test_nested_and_long_nutrition_agree(spark):
    rng = random.Random(5)
    keys = ["protein_g", "carbohydrates_g", "fat_g", "energy_kcal", "salt_g"]
    blocks, rows = [], []
    for a in range(200):
        chosen = {k: float(rng.randint(1, 500 if k == "energy_kcal" else 60)) for k in keys if rng.random() < 0.7}
        units = {k: rng.choice(["g", "g", "stück"]) if k != "energy_kcal" else "kcal" for k in chosen}
        blocks.append((a, ("nutrition_card", "", chosen, [(k, k, v, units[k], f"{v} {units[k]}", True) for k, v in chosen.items()], [])))
        rows += [(a, k, v, units[k], "structured", False, True) for k, v in chosen.items()]
    from shelfproof.schema import NUTRITION
    nested = spark.createDataFrame(blocks, f"asin int, block {NUTRITION.simpleString()}")
    limits = {"energy_kcal": (100.0, 420.0)}
    one = {(r.asin, r.key): r.status for r in nutrition.validate(nested, limits, block="block").select(
        "asin", F.explode("nutrition").alias("e")).select("asin", "e.key", "e.v.status").collect()}
    table = spark.createDataFrame(rows, "asin int, key string, amount double, unit string, source string, derived boolean,"
                                        " basis_confirmed boolean")
    two = {(r.asin, r.key): r.status for r in nutrition.validate_long(table, limits=limits).collect()}
    assert one == two and len(set(one.values())) == 4


# --- snapshots -----------------------------------------------------------------------------

def test_snapshot_difference_names_the_path(listings):
    base = dict(title="t", breadcrumbs=["a", "b"], attributes={"x": "1"}, price=dict(amount=1.0))
    want = listings([dict(base, asin="A"), dict(base, asin="B"), dict(base, asin="gone")]).drop("ord")
    got = listings([dict(base, asin="A"), dict(base, asin="B", breadcrumbs=["a"], attributes={"x": "2", "y": "3"},
                                                price=dict(amount=2.0)), dict(asin="new", title="n")]).drop("ord")
    rows = {(r.asin, r.path): (r.expected, r.actual) for r in snapshot.difference(want, got).collect()}
    assert {p: v for (a, p), v in rows.items() if a == "B"} == {
        "breadcrumbs[]": ("2", "1"), "breadcrumbs[1]": ("b", None), "attributes.x": ("1", "2"), "attributes.y": (None, "3"),
        "price.amount": ("1.0", "2.0")}
    assert rows[("new", "title")] == (None, "n") and rows[("gone", "title")] == ("t", None)
    assert not any(a == "A" for a, _ in rows)
