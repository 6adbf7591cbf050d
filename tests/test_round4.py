"""Cases of the findings of the fourth round."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfproof import plans
from shelfproof.operators import blocks as K
from shelfproof.operators import extract
from shelfproof.operators import pages as P

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_run_report_reads_only_what_it_counts(spark):
    """Errors and pages are counted; blocks that cannot fail are not worked out for it."""
    plan = _plan(plans.QUERIES["page_run_report"](spark, SMALL))
    assert plan.count("MapInArrow") == 1
    after = plan[:plan.index("MapInArrow")]
    assert "data-a-dynamic-image" in after and "dimensionValuesDisplayData" in after
    for token in ("#productTitle", "#corePrice_desktop", "#feature-bullets", "#histogramTable", "#productDescription", "#aplus"):
        assert token not in after


def test_source_counts_reads_only_food_and_errors(spark):
    plan = _plan(plans.QUERIES["page_source_counts"](spark, SMALL))
    assert plan.count("MapInArrow") == 1
    after = plan[:plan.index("MapInArrow")]
    for token in ("#productDescription", "#important-information", "#feature-bullets", "#aplus", "#nic-ingredients-content"):
        assert token in after
    for token in ("#productTitle", "#corePrice_desktop", "#histogramTable", "[data-hook=review]", "#nic-allergens", "#bylineInfo"):
        assert token not in after


def test_scripts_do_not_pass_the_reader_as_nested_columns(spark):
    """Rows with nested columns are weighed by a walk through all of a batch; only flat ones go to Python."""
    pages = spark.createDataFrame([("a", "<p>")], "asin string, html string")
    plan = _plan(extract.extract(pages, "amazon.de"))
    below = plan[plan.rindex("MapInArrow"):]
    assert "_matrix" not in below and "_gallery" not in below and "html" in below


def test_markup_is_known_by_its_text_only_if_nothing_that_follows_changes_it():
    """``<a x="b>`` is a tag where no quote follows, else the quote's end is the value's."""
    first, second = """<i id=k>1</i><a x="b>2</a>""", """<i id=k>1</i><a x="b>2</a>3">4</a><i id=k>5</i>"""
    together = P._Reader(frozenset(["i", "a"]))
    for html in (first, second, first):
        together.read(html)
    alone = []
    for html in (first, second, first):
        reader = P._Reader(frozenset(["i", "a"]))
        reader.read(html)
        alone.append([a.to_pylist()[0] for a in reader.arrays()])
    assert [list(page) for page in zip(*(a.to_pylist() for a in together.arrays()))] == alone
    assert "<i id=k>" in together.known and """<a x="b>""" not in together.known


def test_known_markup_is_not_matched_again(monkeypatch):
    tried = []

    class Counting:
        def __init__(self, pattern):
            self.match, self.pattern = pattern.match, pattern

        def search(self, *args):
            tried.append(args[1:])
            return self.pattern.search(*args)

    monkeypatch.setattr(P, "MARKUP", Counting(P.MARKUP))
    reader = P._Reader(frozenset())
    reader.read("<p class='x'>a</p>" * 100)
    assert len(reader.kinds) == 100 and len(tried) == 2


@pytest.mark.parametrize("script, value, error", [
    # The word stands unquoted, in another quote and as a part of a longer one in front of the key.
    ("""parentAsin, xparentAsin":"no", 'parentAsin' : "P1", "dimensionValuesDisplayData":{"a":["b"]}""", ("P1", {"a": ["b"]}), None),
    (""""dimensionValuesDisplayData"
      :
      {"a":["b"]} "parentAsin":"P2" """, ("P2", {"a": ["b"]}), None),
    (""" dimensionValuesDisplayData "dimensionValuesDisplayData":[1] "currentAsin":"C" """, (None, None),
     "dimensionValuesDisplayData does not have its shape"),
    ("dimensionValuesDisplayData", None, None),
    ("parentAsin", None, None)])
def test_matrix_keys_are_found_where_they_are_quoted(spark, script, value, error):
    df = spark.createDataFrame([("é€" * 3000 + script,), (script,)], "html string")
    for row in df.select(K.variation_matrix(F.col("html")).alias("m")).collect():
        got = row["m"]
        assert (got["error"] if got else None) == error
        assert (got and got["value"] and (got["value"]["parent_asin"], got["value"]["values_by_asin"])) == value


def test_gallery_is_found_behind_other_mentions(spark):
    html = """colorImages "colorImages" 'colorImages' : { 'initial': [{"large":"u"}]} </script>"""
    df = spark.createDataFrame([(html,), ("colorImages",), ("x",)], "html string")
    got = [r["g"] for r in df.select(K.image_records(F.col("html")).alias("g")).collect()]
    assert [r["large"] for r in got[0]["records"]] == ["u"] and got[1]["records"] is None and got[2]["records"] is None
