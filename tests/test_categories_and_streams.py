from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfproof import categories  # noqa: F401
from shelfproof.categories import base as B
from shelfproof.streaming import jobs


def judged(listings, key, records):
    rows = B.evaluate(listings([dict(r, asin=k) for k, r in records.items()]), B.get(key)).collect()
    return {r.asin: r for r in rows}


def test_pasta(listings):
    shelf = ["Lebensmittel", "Nudeln & Pasta"]
    got = judged(listings, "dry_pasta", {
        "dry": dict(breadcrumbs=shelf, title="Spaghetti", content=dict(feature_bullets=["Bronze gezogen"])),
        "fresh": dict(breadcrumbs=shelf, title="Frische Pasta"), "canned": dict(breadcrumbs=["Konserven"] + shelf),
        "brush": dict(breadcrumbs=["Bad"]), "no_trail": dict(title="Spaghetti"),
        "egg": dict(breadcrumbs=shelf, content=dict(description="100% Hartweizen"),
                    food=dict(ingredients=dict(text="Hartweizengrieß, Ei")))})
    assert {k: r.category.text for k, r in got.items()} == dict(
        dry="dry_pasta", fresh="other", canned="other", brush="other", no_trail=None, egg="dry_pasta")
    assert got["dry"].claims["bronze_die"].status == "trusted" and got["dry"].claims["slow_drying"].status == "not_claimed"
    assert got["egg"].axes["raw_materials"].text == "durum_wheat,egg" and got["egg"].claims["pure_durum"].status == "disputed"
    assert got["brush"].axes == {} and got["brush"].claims == {}


def test_paste(listings):
    say = lambda *b: dict(feature_bullets=list(b))
    got = judged(listings, "tyre_mounting_paste", {
        "paste": dict(title="5kg Reifenmontagepaste inkl. Ventildreher, Auswuchtzange", content=say("schnell trocknend")),
        "carbon": dict(title="Max Grip Carbon Montagepaste"), "brush": dict(title="Rundpinsel für Reifenmontagepaste"),
        "plug": dict(title="Montagepaste für Reifen-Reparaturstopfen"), "thread": dict(title="Montagepaste 110 g für Schraubengewinde"),
        "tin": dict(title="Schwammdose 50 ml", content=dict(description="Montagegel für Fahrradreifen")), "silent": dict(title="Dose"),
        "bucket": dict(title="Reifenmontagepaste", content=say("TROCKNET NICHT EIN IM EIMER")),
        "both": dict(title="Reifenmontagepaste", content=say("trocknet nicht ein im Eimer, aber trocknet schnell")),
        "oil": dict(title="Reifenmontagepaste", content=say("Basis: Mineralöl", "trocknet schnell ab"))})
    match = {k: (r.category.text == "tyre_mounting_paste", r.category.status) for k, r in got.items()}
    assert match == dict(paste=(True, "trusted"), carbon=(False, "trusted"), brush=(False, "trusted"), plug=(False, "trusted"),
                         thread=(False, "trusted"), tin=(True, "unverified"), silent=(False, "trusted"), bucket=(True, "trusted"),
                         both=(True, "trusted"), oil=(True, "trusted"))
    dries = {k: got[k].claims["dries_out"].status for k in ("paste", "bucket", "oil")}
    assert dries == dict(paste="trusted", bucket="not_claimed", oil="disputed")
    assert got["paste"].claims["dries_out"].notes and list(got["oil"].suitability.adverse) == ["mineral_oil_base"]


def test_rice(listings):
    de = dict(marketplace="amazon.de")
    card = lambda stars, text: dict(rating=stars, text=text, verified=True)
    got = judged(listings, "basmati_rice", {
        "plain": dict(de, title="Basmatireis 5 kg"), "english": dict(marketplace="amazon.com", title="Basmatireis 5 kg"),
        "cooker": dict(de, title="Reiskocher für Basmati"), "pouch": dict(de, title="Basmati Reis 250g", food=dict(
            ingredients=dict(text="Basmati, Wasser, Sonnenblumenöl"))),
        "declared": dict(de, title="Royal 5 kg", food=dict(ingredients=dict(text="Basmati Reis"))),
        "sella": dict(de, title="Basmati Sella", content=dict(feature_bullets=["naturally aged"])),
        "non": dict(de, title="Basmati non-parboiled"),
        "brown_inside": dict(de, title="Basmati weißer Reis", food=dict(ingredients=dict(text="Brauner Basmati Langkorn Duftreis"))),
        "tilda": dict(de, title="Tilda Pure Original Basmati", brand="Tilda"),
        "fake": dict(de, title="Tilda Pure Original Basmati", brand="Kajal"),
        "grade": dict(de, title="Super Kernel Basmati"), "smelly": dict(de, title="Basmati", reviews=dict(
            sample=[card(5.0, "klebt nicht, toller Duft"), card(1.0, "muffig und klebt")]))})
    assert {k: r.category.text == "basmati_rice" for k, r in got.items()} == dict(
        plain=True, english=False, cooker=False, pouch=False, declared=True, sella=True, non=True, brown_inside=True, tilda=True,
        fake=True, grade=True, smelly=True)
    assert (got["sella"].grain_type.text, got["sella"].claims["aged"].status) == ("parboiled", "disputed")
    assert (got["non"].grain_type.text, got["non"].grain_type.status) == ("white", "unverified")
    assert got["brown_inside"].declaration_conflict is None or got["brown_inside"].declaration_conflict.text == "brown"
    assert (got["tilda"].external_test.status, got["fake"].external_test.status) == ("trusted", "unverified")
    assert got["grade"].cultivar.flags == ["trade_grade"] and got["plain"].cultivar.status == "not_claimed"
    signals = {k: v.status for k, v in got["smelly"].review_signals.items()}
    assert (signals["aroma"], signals["fluffy"], signals["sticky"], signals["odd_smell"]) == ("unverified",) * 4
    assert signals["insects"] == "unknown"
    for r in got.values():
        if r.score is not None:
            assert 0 <= r.score.total <= 100 and abs(r.score.total - 50) <= abs(r.score.raw - 50) + 0.1
    assert got["plain"].score.unknown == ["laboratory result", "review signal", "variety", "milling degree", "country of origin",
                                          "price per kg", "rating track record"]
    assert got["tilda"].score.parts.health == 0.9 and got["fake"].score.parts.health == 0.7


def test_budget_reads_like_one_pass(spark, tmp_path):
    """Several batches, shared products, one dominant query: equal to reading the log in order."""
    rng = random.Random(11)
    log = [("r%d" % rng.randint(0, 1), "q0" if rng.random() < 0.5 else "q%d" % rng.randint(1, 4), "p%d" % rng.randint(0, 30), i)
           for i in range(240)]
    want, seen, used = set(), set(), {}
    for run, q, p, i in log:
        if (run, p) in seen or used.get((run, q), 0) >= 4:
            continue
        seen.add((run, p))
        used[(run, q)] = used.get((run, q), 0) + 1
        want.add((run, q, p, i))
    table = jobs.Merged(str(tmp_path / "accepted"), lambda rows: rows, every=2)
    accept = jobs.budget(table, 4)
    for b in range(6):
        batch = spark.createDataFrame(log[b * 40:(b + 1) * 40], "run_id string, query string, asin string, seen_at int")
        accept(batch, b)
        accept(batch, b)  # a repeated batch replaces its own output
    assert {(r.run_id, r.query, r.asin, r.seen_at) for r in table.read(spark).collect()} == want
    kept = {f.name for f in (tmp_path / "accepted" / "batches").iterdir()}
    assert kept == {"at=4", "at=5"} and len(list((tmp_path / "accepted" / "tables").iterdir())) == 2


def test_late_older_copies_lose(spark, tmp_path):
    source, table = tmp_path / "in", jobs.Merged(str(tmp_path / "out"), jobs.freshest_of("asin"), every=2)

    def each(batch, batch_id):
        state = batch.withColumn("stamp", F.try_to_timestamp("s"))
        for _ in range(2):  # a repeated batch replaces its own output
            table.write(jobs.freshest(state, "asin", "stamp", "ord", ["title"]), batch_id)

    for rows in ([("A", "2026-01-02", 0, "first"), ("B", "2026-01-01", 1, "b")],
                 [("A", "2026-01-01", 2, "older"), ("A", "2026-01-02", 3, "equal"), ("B", None, 4, "undated")],
                 [("C", None, 5, "c"), (None, "2026-01-01", 6, "no id")], [("C", "2020-01-01", 7, "dated")], [("A", None, 8, "x")]):
        spark.createDataFrame(rows, "asin string, s string, ord long, title string").coalesce(1) \
            .write.mode("append").json(str(source))
        stream = spark.readStream.schema("asin string, s string, ord long, title string").json(str(source))
        jobs.run_batches(stream, str(tmp_path / "ck"), each).awaitTermination()
    got = {r.asin: (r.capture.title, r.captures) for r in table.read(spark).collect()}
    assert got == {"A": ("first", 4), "B": ("b", 2), "C": ("dated", 2), None: ("no id", 1)}


def test_state_of_closed_runs_is_dropped(spark, tmp_path):
    source, table = tmp_path / "in", jobs.Merged(str(tmp_path / "out"), jobs.newest_of("run_id", "asin"), every=2)
    schema = "run_id string, run_started timestamp, asin string, seen_at_ts timestamp, position int"
    state = []
    for day in range(1, 9):
        rows = [(f"r{day}", f"2026-01-0{day} 00:00:00", f"p{i % 5}", f"2026-01-0{day} 00:{59 - i}:00", i) for i in range(20)]
        rows += [("r1", "2026-01-01 00:00:00", "late", "2026-01-01 00:00:00", day)]
        spark.createDataFrame(rows, "run_id string, a string, asin string, b string, position int").selectExpr(
            "run_id", "CAST(a AS timestamp) run_started", "asin", "CAST(b AS timestamp) seen_at_ts", "position").coalesce(1) \
            .write.mode("append").parquet(str(source))
        once = jobs.distinct_sightings(spark.readStream.schema(schema).parquet(str(source)), ["position"])
        query = jobs.run_batches(once, str(tmp_path / "ck"), table.write, "update")
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r.run_id, r.asin): r.first.position for r in table.read(spark).collect()}
    assert got == {**{(f"r{d}", f"p{i}"): 15 + i for d in range(1, 9) for i in range(5)}, ("r1", "late"): 1}
    assert max(state) <= 5 * 4 + 1 and state[-1] <= 5 * 4  # as many rows as the open runs have, not as all runs
