"""Trust rules on the smallest listing that shows each."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from shelfproof.functions import values as V
from shelfproof.operators.validate import Profile, serialise, validate


def pack(total, unit="g", source="unit_count", **kw):
    return dict(total_quantity_base=total, total_quantity_unit=unit, total_quantity_source=source, **kw)


def checked(listings, records, profile=Profile()):
    rows = serialise(validate(listings(records), profile)).collect()
    return {r.asin: json.loads(r.json) for r in rows}


def test_pack_size(listings):
    cases = {
        "count": (dict(title="Pasta 16 x 500 g", package=pack(8000.0)), "trusted"),
        "wrong": (dict(title="Pasta 16 x 500 g", package=pack(500.0)), "disputed"),
        "er_pack": (dict(title="Fusilli 500 g (5er Pack)", package=pack(2500.0)), "trusted"),
        "packs_of": (dict(title="6 Stück à 250 g", package=pack(1500.0)), "trusted"),
        "leading": (dict(title="16x Garofalo Fusilli mit 500g", package=pack(8000.0)), "trusted"),
        "not_fifty": (dict(title="Packung mit 500g", package=pack(500.0)), "trusted"),
        "silent": (dict(title="Pasta", package=pack(500.0)), "unverified"),
        "bare": (dict(title="Paste 5 kg", package=pack(5000.0)), "trusted"),
        "bare_only_confirms": (dict(title="Paste 5 kg", package=pack(1000.0)), "unverified"),
        "other_dimension": (dict(title="Tube 50 ml", package=pack(50.0)), "unverified"),
        "bullet": (dict(title="Bike Fluid", package=pack(5.0), content=dict(feature_bullets=["5 g Tube"])), "trusted"),
        "one_agrees": (dict(title="Set 20x500g (2er Pack)", package=pack(10000.0)), "trusted"),
        "outweighs": (dict(title="12 x 500 g", package=pack(
            6000.0, source="item_weight_x_count", item_weight_base=10000.0, package_weight_base=6500.0)), "disputed"),
        "matrix": (dict(title="Pasta", package=pack(5000.0), variation=dict(
            dimensions=["flavor_name", "size_name"], values_by_asin={"matrix": ["Weiß", "5 kg"]})), "trusted"),
        "colour": (dict(title="Pasta", package=pack(5000.0), variation=dict(
            dimensions=["color_name"], values_by_asin={"colour": ["5 kg"]})), "unverified"),
        "nothing": (dict(title="Pasta 500 g"), "unknown"),
    }
    got = checked(listings, [dict(r, asin=k) for k, (r, _) in cases.items()])
    assert {k: got[k]["quantity"]["status"] for k in cases} == {k: s for k, (_, s) in cases.items()}
    assert got["count"]["quantity"]["evidence"][1] == {"field": "title", "quote": "16 x 500 g"}


def test_prices(listings):
    eur = lambda a: dict(amount=a, currency="EUR", text=f"{a} EUR")
    trusted = dict(title="Pasta 2 x 500 g", package=pack(1000.0))
    cases = {
        "derived": (dict(trusted, price=eur(4.0)), ("trusted", 4.0, "derived")),
        "agrees": (dict(title="Pasta", package=pack(1000.0), price=eur(4.0), unit_price=dict(amount=4.1, unit="kg")),
                   ("trusted", 4.0, "derived")),
        "disagrees": (dict(title="Pasta", package=pack(1000.0), price=eur(4.0), unit_price=dict(amount=8.0, unit="kg")),
                      ("disputed", 4.0, "derived")),
        "pack_wins": (dict(trusted, price=eur(4.0), unit_price=dict(amount=8.0, unit="kg")), ("trusted", 4.0, "derived")),
        "hundred": (dict(title="Pasta", package=pack(1000.0), price=eur(4.0), unit_price=dict(amount=0.4, unit="100 g")),
                    ("trusted", 4.0, "derived")),
        "pieces": (dict(title="Pasta", package=pack(1000.0), price=eur(4.0), unit_price=dict(amount=4.0, unit="Stück")),
                   ("unverified", 4.0, "derived")),
        "litre_for_grams": (dict(title="Pasta", package=pack(1000.0), price=eur(4.0), unit_price=dict(amount=4.0, unit="l")),
                            ("unverified", 4.0, "derived")),
        "bad_pack": (dict(title="16 x 500 g", package=pack(500.0), price=eur(31.28)), ("disputed", 62.56, "derived")),
        "range": (dict(trusted, price=dict(range=[5.63, 26.15], currency="EUR")), ("unknown", None, "")),
        "band": (dict(trusted, price=eur(100.0)), ("disputed", 100.0, "derived")),
        "volume": (dict(title="Oil 2 x 500 ml", package=pack(1000.0, "ml"), price=eur(4.0)), ("trusted", 4.0, "derived")),
    }
    got = checked(listings, [dict(r, asin=k) for k, (r, _) in cases.items()], Profile("p", "p", {}, (0.8, 40.0)))
    seen = {k: (v["price_per_base"]["status"], v["price_per_base"]["value"], v["price_per_base"]["source"]) for k, v in got.items()}
    assert seen == {k: want for k, (_, want) in cases.items()}
    assert got["volume"]["price_per_base"]["unit"] == "EUR/l"
    assert any("3.91" in n for n in got["bad_pack"]["price_per_base"]["notes"])
    assert got["range"]["price"]["evidence"][0]["field"] == "price.range"


def nutrition(source="nutrition_card", rows=(), derived=(), **values):
    return dict(food=dict(nutrition=dict(source=source, per_100g=values, rows=list(rows), derived=list(derived))))


def row(key, amount, unit, text, confirmed=False):
    return dict(key=key, label=key, amount=amount, unit=unit, value_text=text, basis_confirmed=confirmed)


def test_nutrition(listings):
    good = dict(energy_kcal=350.0, protein_g=12.0, carbohydrates_g=70.0, fat_g=1.5)
    records = {
        "good": nutrition(**good),
        "wrong_unit": nutrition(fiber_g=353.0, protein_g=12.0, rows=[row("fiber_g", 353, "kcal", "353 kcal")]),
        "basis": nutrition("text:description", rows=[row("protein_g", 100, "g", "Eiweiß pro 100g", True)], protein_g=100.0),
        "heavy": nutrition(protein_g=50.0, carbohydrates_g=50.0, fat_g=10.0),
        "clash": nutrition(energy_kcal=100.0, protein_g=12.0, carbohydrates_g=70.0, fat_g=1.5),
        "explained": nutrition(energy_kcal=87.7, protein_g=12.0, carbohydrates_g=70.0, fat_g=1.5),
        "lone": nutrition(protein_g=12.0),
        "twin": nutrition(energy_kj=1500.0, energy_kcal=358.5, derived=["energy_kcal"]),
        "prose": nutrition("text:description", rows=[row("protein_g", 12, "g", "12 g"), row("fat_g", 1.5, "g", "1,5 g", True)],
                           protein_g=12.0, fat_g=1.5),
    }
    bands = Profile("p", "p", {"energy_kcal": (90.0, 420.0)})
    got = {k: {n: v["status"] for n, v in r["nutrition"].items()}
           for k, r in checked(listings, [dict(r, asin=k) for k, r in records.items()], bands).items()}
    assert set(got["good"].values()) == {"trusted"}
    assert got["wrong_unit"] == {"fiber_g": "unknown", "protein_g": "unverified"}
    assert got["basis"] == {"protein_g": "unknown"}
    assert set(got["heavy"].values()) == {"disputed"}
    assert set(got["clash"].values()) == {"unverified"}
    assert got["explained"] == {"energy_kcal": "disputed", "protein_g": "trusted", "carbohydrates_g": "trusted", "fat_g": "trusted"}
    assert got["lone"] == {"protein_g": "unverified"}
    assert got["twin"] == {"energy_kj": "trusted", "energy_kcal": "unverified"}
    assert got["prose"] == {"protein_g": "unverified", "fat_g": "trusted"}


HISTOGRAM = dict(five_star=71, four_star=13, three_star=5, two_star=4, one_star=7)


def test_reviews(listings):
    card = lambda **kw: dict(dict(rating=1.0, title="Nie wieder", text="Der Reis klebt sehr.", verified=True,
                                  home_marketplace=True), **kw)
    rated = lambda v, n, h, **kw: dict(rating=dict(value=v, count=n), reviews=dict(histogram_percent=h, **kw))
    records = {
        "agrees": rated(4.4, 100, HISTOGRAM), "disagrees": rated(3.0, 100, HISTOGRAM), "thin": rated(4.4, 5, HISTOGRAM),
        "incomplete": rated(4.4, 100, dict(five_star=50)), "none": dict(rating=dict(value=4.4, count=100)),
        "sample": rated(4.4, 100, HISTOGRAM, sample=[card(), card(home_marketplace=False, country="Italien", variant="a"),
                                                     card(variant="b", verified=False)]),
    }
    got = checked(listings, [dict(r, asin=k) for k, r in records.items()])
    status = lambda f: {k: v[f]["status"] for k, v in got.items()}
    assert status("review_rating") == {"agrees": "trusted", "disagrees": "disputed", "thin": "unverified",
                                       "incomplete": "disputed", "none": "unverified", "sample": "trusted"}
    assert status("review_negative_share") == {"agrees": "trusted", "disagrees": "trusted", "thin": "unverified",
                                               "incomplete": "unknown", "none": "unknown", "sample": "trusted"}
    assert got["agrees"]["review_negative_share"]["value"] == 11.0
    sample = got["sample"]["review_sample"]
    assert (sample["value"], sample["status"], sample["flags"]) == (3.0, "unverified", ["pooled_variants"])
    assert len(sample["notes"]) == 4


def test_value_updates_keep_the_value(spark):
    v = V.value(5.0, status=V.UNVERIFIED, unit="g")
    r = spark.range(1).select(V.disputed(v, "why", F.array(V.evidence("f", "q"))).alias("v")).first().v
    assert (r.value, r.status, r.notes, r.evidence[0].quote) == (5.0, "disputed", ["why"], "q")
