from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfproof.functions import labels as LB
from shelfproof.functions import text as TX
from shelfproof.operators import pages as P


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
    return [r.c for r in df.select("i", build(F.col("t")).alias("c")).orderBy("i").collect()]


def test_numbers_of_two_locales(spark):
    texts = ["12,9g", "3000.0 gramm", "1.234,56 €", "2.500 g", "1,5 kg", "1,500", "-3", "none", None, "1 234,5"]
    assert column(spark, texts, lambda c: TX.number(c, ",")) == [
        12.9, 3000.0, 1234.56, 2500.0, 1.5, 1.5, -3.0, None, None, 1234.5]
    assert column(spark, ["1,500", "1,234.5", "2.500"], lambda c: TX.number(c, ".")) == [1500.0, 1234.5, 2.5]
    assert column(spark, ["12", "12,5"], lambda c: TX.whole_number(c, ",")) == [12, None]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.decimals(min_value=0, max_value=9_999_999, places=2), min_size=5, max_size=40))
def test_number_reads_back_what_a_locale_writes(spark, values):
    german = [f"{v:,.2f}".translate(str.maketrans(",.", ".,")) + " €" for v in values]
    assert column(spark, german, lambda c: TX.number(c, ",")) == [float(v) for v in values]
    assert column(spark, [f"${v:,.2f}" for v in values], lambda c: TX.number(c, ".")) == [float(v) for v in values]


def test_clean_drops_marks_and_rejoins_words(spark):
    texts = ["Marke ‏ : ‎", "HARTWEIZENGRIEß , Wasser .", "DINKEL -VOLLKORN", "bis -18 °C", "( a )", "a\xa0 b", ""]
    assert column(spark, texts, TX.clean) == [
        "Marke:", "HARTWEIZENGRIEß, Wasser.", "DINKEL-VOLLKORN", "bis -18 °C", "(a)", "a b", ""]


def test_entities_are_undone_once(spark):
    texts = ["13,56&nbsp;&euro; pro kg", "&amp;nbsp; &#8364;", "no entity  here", "&bogusname;x &amp;"]
    assert column(spark, texts, TX.decode_entities) == ["13,56 € pro kg", "&nbsp; €", "no entity  here", "&bogusname;x &"]


def test_quantities(spark):
    got = column(spark, ["500 Gramm", "1,5 kg", "6 x 500g", "2× 0,5 Liter", "12 Stück"], lambda c: TX.quantity(c, ","))
    assert [q and (q.amount, q.unit, q.base) for q in got] == [
        (500, "g", 500), (1.5, "kg", 1500), (3000, "g", 3000), (1.0, "l", 1000), None]


def test_labels(spark):
    assert column(spark, ["Artikelgewicht:", " ANZAHL  der Artikel ", "Unbekannt"], LB.attribute_key) == [
        "item_weight", "item_count", None]
    assert column(spark, ["— davon gesättigte Fettsäuren", "Fettgehalt", "Vitamin C"], LB.nutrient_key) == [
        "saturated_fat_g", "fat_g", None]
    assert column(spark, ["Besuche den Barilla-Store", "Marke: De Cecco"], LB.byline) == ["Barilla", "De Cecco"]
    assert column(spark, ["9 Personen fanden", "Eine Person fand das", "1.234 Personen fanden", "x"], LB.helpful_votes) == [
        9, 1, 1234, None]
    lines = column(spark, ["Bewertet in Deutschland am 6. Juli 2026", "Bewertet in Italien am 11. März 2026", "x"],
                   lambda c: LB.dateline(c, "de", F.lit("deutschland")))
    assert [(d.country, str(d.date), d.home) for d in lines] == [
        ("Deutschland", "2026-07-06", True), ("Italien", "2026-03-11", False), (None, "None", None)]
    english = column(spark, ["Reviewed in the United States on July 6, 2026", "Reviewed in the United Kingdom on 7 May 2025"],
                     lambda c: LB.dateline(c, "en", F.lit("the united states")))
    assert [(str(d.date), d.home) for d in english] == [("2026-07-06", True), ("2025-05-07", False)]


def test_hosts_locales_and_ids(spark):
    assert column(spark, ["https://www.Amazon.de/x", "www.amazon.com/", None], LB.host_key) == ["amazon.de", "amazon.com", ""]
    status = column(spark, ["de-DE,de;q=0.9", "en-US", " "], lambda c: LB.locale_status(c, F.lit("de")))
    assert [(s.language, s.status) for s in status] == [("de", "matches"), ("en", "conflict"), (None, "unset")]
    assert column(spark, ["B0CH3LLJT5; https://x/dp/B0CH3LLJT6,B0CH3LLJT5"], LB.product_ids) == [["B0CH3LLJT5", "B0CH3LLJT6"]]
    with pytest.raises(Exception, match="neither a product id"):
        column(spark, ["nonsense"], LB.product_ids)


def test_word_stems(spark):
    texts = ["Basmatireis", "basmati rice", "xbasmati"]
    for language, want in (("de", [True, True, False]), ("en", [False, True, False])):
        assert column(spark, texts, lambda c: F.rlike(c, TX.word_pattern("basmati", language))) == want
    with pytest.raises(Exception, match="stem must not be empty"):
        column(spark, ["x"], lambda c: F.rlike(c, TX.word_pattern(" ", "de")))


def test_redaction(spark):
    page = ("ue_sid = '123-1234567-1234567'; ue_id='ABCDEFGH'; x=ABCDEFGH&s=123-1234567-1234567 "
            '<div data-rid="ABCDEFGHIJ">{"ipAddress":"1.2.3.4"} 999-1234567-1234567')
    assert column(spark, [page], P.redact) == [
        "ue_sid = '000-0000000-0000000'; ue_id='XXXXXXXXXXXXXXXXXXXX'; x=XXXXXXXXXXXXXXXXXXXX&s=000-0000000-0000000 "
        '<div data-rid="00000000-0000-0000-0000-000000000000">{"ipAddress":"0.0.0.0"} 000-0000000-0000000']
