"""Extraction from inline pages, page stores, runs and sightings."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from shelfproof.operators import extract, merge, pages as P, sightings
from shelfproof.sources import feeds, runs


def records(spark, htmls, host="amazon.de"):
    df = spark.createDataFrame([(k, "run", h, "2026-01-01T00:00:00+00:00") for k, h in htmls.items()],
                               "asin string, run_id string, html string, fetched_at string")
    return {r.asin: r.asDict(True) for r in extract.extract(df, host).collect()}


TITLE = "<span id=productTitle>Spaghetti 6 x 500 g</span>"
BOX = "<div id='corePrice_desktop'>%s</div>"


def test_product_pages(spark):
    offscreen = "<span class='a-offscreen'>%s</span>"
    table = "<div id='productOverview_feature_div'><table>%s</table></div>"
    got = records(spark, {
        "price": TITLE + BOX % (offscreen % "1.234,56&nbsp;€"),
        "range": TITLE + BOX % ("<span class='a-price-range'>" + offscreen % "5,63€" + " - " + offscreen % "26,15€" + "</span>"),
        "rebuilt": TITLE + BOX % (offscreen % "EUR097" + "<span class='a-price-whole'>0</span><span class='a-price-fraction'>97</span>"),
        "carousel": TITLE + "<div class='carousel'>" + offscreen % "9,99 €" + "</div>",
        "savings": TITLE + "<span id='apex-pricetopay-accessibility-label'>3,39 € mit 5 Prozent Einsparungen</span>",
        "tables": TITLE + table % (
            "<tr><td>Marke:<td>Barilla<tr><td>Größe</td><td><table><tr><th>Innen</th><td>x</td></tr></table></td></tr>"
            "<tr><td>Marke</td><td>zweite</td></tr><tr><td>a</td><td>b</td><td>c</td></tr>"),
        "weight_as_count": TITLE + table % "<tr><td>Stückzahl</td><td>500.0 gramm</td></tr>",
        "millilitres": "<span id=title>Tin</span>" + table % "<tr><td>Anzahl der Einheiten</td><td>50.0 milliliter</td></tr>",
        "style": TITLE + "<div id=productDescription>Gut<style>p{}</style><script>x()</script> und <b>frisch</b>, ja</div>",
        "card": TITLE + "<div id='nic-eu-nutrition-facts'><table><tr><th>Energie</th><td>1500 kJ</td></tr>"
                        "<tr><th>Eiweiß</th><td>12,5 g</td></tr></table></div>",
        "kcal_first": TITLE + table % ("<tr><td>Brennwert</td><td>350 kcal</td></tr><tr><td>Fett</td><td>2 g</td></tr>"),
        "aplus": TITLE + "<div id='aplus'><style>x</style><div class='aplus-module premium-module-1'><h3>Kopf</h3><p>Text</p>"
                         "<img src='a.jpg' alt='A'><img src='grey-pixel.gif'></div><table><tr><td>a</td></tr><tr><td>b</td></tr></table></div>",
        "literal": TITLE + "<script>x = {'colorImages': {'initial': [{\"main\":{\"s.jpg\":[10],\"l.jpg\":[90]}}]}, 'z': 1}</script>",
        "dynamic": TITLE + "<img id=landingImage data-a-dynamic-image='{\"s.jpg\":[1,1],\"l.jpg\":[9,9]}'>",
        "broken": "<<<div id='productTitle'",
    })
    price = {k: r["price"] for k, r in got.items()}
    assert price["price"]["amount"] == 1234.56 and price["price"]["currency"] == "EUR"
    assert price["range"]["amount"] is None and price["range"]["range"] == [5.63, 26.15]
    assert price["rebuilt"]["amount"] == 0.97 and price["carousel"] is None
    assert price["savings"] == dict(amount=3.39, currency="EUR", text="3,39 €", range=None)
    assert got["tables"]["raw_tables"] == {"Marke": "Barilla", "Größe": "Innen x", "Innen": "x"}
    assert got["tables"]["brand"] == "Barilla"
    assert got["weight_as_count"]["package"]["unit_count_base"] == 500.0
    assert got["weight_as_count"]["package"]["item_count"] is None
    assert (got["millilitres"]["package"]["total_quantity_unit"], got["millilitres"]["title"]) == ("ml", "Tin")
    assert got["price"]["package"]["total_quantity_source"] == "title_multipack"
    assert got["price"]["package"]["total_quantity_base"] == 3000.0
    assert got["style"]["content"]["description"] == "Gut und frisch, ja"
    card = got["card"]["food"]["nutrition"]
    assert card["source"] == "nutrition_card" and card["per_100g"] == dict(energy_kj=1500.0, protein_g=12.5, energy_kcal=358.5)
    assert card["derived"] == ["energy_kcal"]
    assert got["kcal_first"]["food"]["nutrition"]["per_100g"] == dict(energy_kcal=350.0, fat_g=2.0)
    aplus = got["aplus"]["content"]["aplus"]
    assert (aplus["headings"], aplus["images"], aplus["tables"]) == (["Kopf"], [dict(url="a.jpg", alt="A")], [[["a"], ["b"]]])
    assert aplus["module_types"] == ["premium-module-1"] and aplus["text"] == "Kopf Text a b"
    assert got["literal"]["media"]["primary_image"] == "l.jpg" and got["literal"]["media"]["image_source"] == "color_images"
    assert got["dynamic"]["media"]["primary_image"] == "l.jpg" and got["dynamic"]["media"]["image_source"] == "dynamic_image"
    assert got["broken"]["title"] == "" and got["broken"]["price"] is None


def test_gates(spark):
    htmls = {"ok": "<title>Shop</title>" + TITLE, "title": "<title>Robot Check</title>", "form": "<form action='/x/validateCaptcha'>",
             "words": "<p>Enter the characters you see below</p>", "empty": "<p>no title node</p>",
             "big": "<p>Enter the characters you see below</p>" + TITLE + "x" * 120_000}
    df = spark.createDataFrame(list(htmls.items()), "asin string, html string")
    got = {r.asin: (r.challenge, r.parse_failed) for r in P.gate(df).select("asin", "challenge", "parse_failed").collect()}
    assert got == {"ok": (None, False), "title": ("robot_check_title", False), "form": ("captcha_form", False),
                   "words": ("challenge_text", False), "empty": (None, True), "big": (None, False)}


def test_a_stored_page_of_many_lines_is_one_row(spark, tmp_path):
    with gzip.open(tmp_path / "B000000001.html.gz", "wt", encoding="utf-8") as fh:
        fh.write(TITLE + "\n<p>one</p>\n\n<p>two</p>\n")
    got = [(r.asin, r.html) for r in runs.read_pages(spark, str(tmp_path), "r1").collect()]
    assert got == [("B000000001", TITLE + "\n<p>one</p>\n\n<p>two</p>\n")]


def test_run_folder_round_trip(spark, tmp_path):
    store = tmp_path / "pages"
    store.mkdir()
    for asin in ("B000000001", "B000000002"):
        with gzip.open(store / f"{asin}.html.gz", "wt", encoding="utf-8") as fh:
            fh.write(TITLE + f"<a>{asin} 123-1234567-1234567</a>")
    (tmp_path / "manifest.json").write_text(json.dumps(dict(
        run_id="r1", marketplace="amazon.de", locale=dict(accept_language="de-DE", language="de"), stats={"a/b": 3, "c": 1.5}), indent=1))
    manifests = runs.read_manifests(spark, str(tmp_path / "manifest.json"))
    stats = runs.run_stats(manifests)
    assert {(r.key, r.value) for r in stats.collect()} == {("a/b", "3"), ("c", "1.5")}
    runs.write_manifests(manifests, stats, str(tmp_path / "manifests"))
    assert runs.read_manifests(spark, str(tmp_path / "manifests")).first().stats == {"a/b": "3", "c": "1.5"}
    assert runs.tag_locale(manifests).first().locale_check.status == "matches"
    pages = runs.read_pages(spark, str(store), "r1")
    runs.write_pages(pages, str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert stored.where(F.col("html").contains("123-1234567")).count() == 0 and stored.count() == 2
    crawl = spark.createDataFrame([("B000000001", "query", None, 1)],
                                  "asin string, search_query string, locale string, ord int")
    again = {r.asin: r for r in extract.reextract(stored, manifests, "amazon.de", crawl).collect()}
    assert again["B000000001"].search_query == "query" and again["B000000001"].locale is None
    assert again["B000000002"].search_query is None and again["B000000002"].locale == "de"
    assert again["B000000002"].product_url == "https://amazon.de/dp/B000000002"
    feeds.write_feed(extract.reextract(stored, manifests, "amazon.de"), str(tmp_path / "feed"))
    back = feeds.read_feed(spark, str(tmp_path / "feed"))
    assert {r.asin for r in back.collect()} == {"B000000001", "B000000002"}
    assert [r.asin for r in merge.unseen(stored, crawl).select("asin").collect()] == ["B000000002"]


def test_search_page(spark):
    tile = "<div class='s-result-item {c}' {g} data-asin='{a}'>{x}</div>"
    grid = "data-component-type='s-search-result'"
    html = (tile.format(c="", g="", a="", x="<h2><span>ad</span></h2>")
            + tile.format(c="", g=grid, a="B000000001", x="<h2><span>One</span></h2><span class='a-price'><span class='a-offscreen'>1,99 €</span></span>")
            + tile.format(c="AdHolder", g=grid, a="", x="<a href='/sspa/click?url=%2Fdp%2FB000000002%3F'><h2><span>Two</span></h2></a>")
            + "<span class='s-pagination-item'>7</span><span class='s-pagination-item'>Weiter</span>")
    df = spark.createDataFrame([("q", html)], "query string, html string")
    got = sightings.sightings(df, "amazon.de").orderBy("position").collect()
    assert [(r.position, r.grid_position, r.asin, r.sponsored_markers, r.result_title, r.result_price_amount) for r in got] == [
        (2, 1, "B000000001", [], "One", 1.99), (3, 2, "B000000002", ["ad_holder", "sspa_link"], "Two", None)]
    assert sightings.last_page(df).first().last_page == 7


def test_blocks_that_fail_leave_the_others(spark):
    gallery = "<script>x = {'colorImages': {'initial': %s}}</script>"
    matrix = "<script>d = {\"dimensionValuesDisplayData\": %s, \"z\": 1}</script>"
    got = records(spark, {
        "odd": TITLE + gallery % "[\"x\"]" + matrix % "[1]", "sizes": TITLE + gallery % "[{\"main\": {\"a\": 5}}]",
        "hires": TITLE + gallery % "[{\"hiRes\": \"h\", \"main\": {\"a\": 5}}]", "thumb": TITLE + gallery % "[{\"main\": {}, \"thumb\": \"t\"}]",
        "broken": TITLE + gallery % "[{\"hiRes\": " + matrix % "{\"A\": [", "null": TITLE + gallery % "null" + matrix % "null",
        "digits": TITLE + "<div data-hook=review><span data-hook=review-body>Gut</span><span data-hook=review-date>"
                          "Bewertet in Italien am ６. März ２０２６</span></div>",
        "references": "<span id=title>a&amp;#xD800;b&amp;#150;c&amp;#0;d&amp;#1;e</span>"})
    errors = {k: {e["block"]: e["error"] for e in r["extraction"]["errors"]} for k, r in got.items()}
    assert set(errors["odd"]) == {"media", "variation"} and set(errors["sizes"]) == {"media"}
    assert not any(errors[k] for k in ("hires", "thumb", "broken", "null", "digits", "references"))
    assert got["hires"]["media"]["primary_image"] == "h" and got["thumb"]["media"]["primary_image"] == "t"
    assert got["odd"]["title"] == got["sizes"]["title"] == "Spaghetti 6 x 500 g" and got["odd"]["media"] is None
    for r in got.values():
        log = r["extraction"]
        assert len(log["blocks_present"]) + len(log["blocks_absent"]) + len({e["block"] for e in log["errors"]}) == len(extract.BLOCKS)
    assert got["digits"]["reviews"]["sample"][0]["text"] == "Gut"


def test_selectors_equal_a_scan_of_all_elements(spark):
    """Places by the index are those that a walk over all elements finds."""
    import random
    rng, htmls = random.Random(5), {}
    for n in range(30):
        out, depth = "", []
        for _ in range(120):
            if depth and rng.random() < 0.45:
                out += f"</{depth.pop()}>"
            else:
                tag = rng.choice(["div", "span", "b", "section"])
                out += f"<{tag} class='{' '.join(rng.sample(['a', 'b', 'ab', 'c'], 2))}' id={rng.choice(['x', 'y', 'xz'])} data-hook=h{rng.randint(0, 2)}>"
                depth.append(tag)
        htmls[str(n)] = out
    page = P.Page()
    asked = [("div .a", "span"), ("#x", ".b", "b"), ("[data-hook=h1]", "div .c"), ("#x*",), (".*b*", "section"), ("section",)]
    columns = {f"s{i}": page.places(*steps) for i, steps in enumerate(asked)}
    df = P.tokenise(spark.createDataFrame(list(htmls.items()), "k string, html string"), page).withColumns(columns)

    def carries(e, step):
        seg = e.seg.split()
        return all(any(t[0] == k[0] and (k[2:-1] in t if k[1] == "*" else t[1:].startswith(k[1:-1])) for t in seg[1:]) if k.endswith("*")
                   else k in seg[1:] if k[0] in "#.[" else e.tag == k for k in step.split())

    for r in df.collect():
        for i, steps in enumerate(asked):
            found = [e for e in r.els if carries(e, steps[0])]
            for step in steps[1:]:
                found = [e for e in r.els if carries(e, step) and any(o.ord < e.ord <= o.last for o in found)]
            assert r[f"s{i}"] == [e.ord for e in found], steps


def test_lineage_needs_an_order(spark):
    pages = spark.createDataFrame([("A", "x")], "asin string, run_id string")
    try:
        merge.lineage(pages, pages, ["run_id"])
    except ValueError as problem:
        assert "ord" in str(problem)
    else:
        raise AssertionError("a feed without an order was taken")
