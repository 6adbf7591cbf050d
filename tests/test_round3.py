"""Cases of the findings of the third round."""

from __future__ import annotations

import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfproof import plans
from shelfproof.functions import text, values
from shelfproof.llm import common
from shelfproof.operators import pages as P

SMALL = "/root/testdata/sf0.001"


def test_padded_pages_are_read_once(spark):
    plan = plans.QUERIES["page_padded"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_reader_remembers_tags_and_keeps_counts_by_page():
    reader = P._Reader(frozenset(["tr", P.CELL, ".x", "#q*"]))
    for html in ("<table><tr><td class='x'>1<td>2<tr><th id='q1'>3</table>", "", "<tr><td class='x'>4</tr><b class='x'/>"):
        reader.read(html)
    nodes, els, idx, errors = (a.to_pylist() for a in reader.arrays())
    assert nodes == [["1", "2", "3"], [], ["4"]] and errors == [None] * 3
    assert [[(e["ord"], e["last"], e["cells"], e["cells_end"]) for e in page] for page in els] == [
        [(0, 5, 0, 3), (1, 3, 0, 2), (2, 2, 0, 1), (3, 3, 1, 2), (4, 5, 2, 3), (5, 5, 2, 3)], [],
        [(0, 1, 0, 1), (1, 1, 0, 1), (2, 2, 1, 1)]]
    assert [dict(i) for i in idx] == [{"tr": [1, 4], ".x": [2], P.CELL: [2, 3, 5], "#q*": [5]}, {},
                                      {"tr": [0], ".x": [1, 2], P.CELL: [1]}]
    assert len(reader.tags) == len(reader.known) == 6


def test_elements_leave_by_the_megabyte():
    """Not more than a little over a megabyte of source has its elements in a worker's memory at once."""
    pages = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["<i>" * 40_000] * 40)], names=["id", "html"])
    out = list(P._tokenised(iter([pages]), frozenset(), ["id"], "html", P.CHUNK_CHARS))
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(40))
    assert max(b.num_rows for b in out) <= 9


@pytest.mark.parametrize("name", ["page_titles", "page_bullets"])
def test_references_without_semicolon(spark, tmp_path, name):
    html = ["<title>a &amp</title><h1>b &lt c&amp;amp d</h1><li>it&#39s &quot</li>", "<title>&gt;&amp;lt</title><h1>&#39</h1><li>x</li>"]
    pq.write_table(pa.table({"page_id": [1, 2], "html": html}), tmp_path / "pages.parquet")
    job = plans.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = db.sql(f"SELECT {', '.join(job.columns)} FROM ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, job.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["decoded_entities", "quantity_parse", "locale_number", "attribute_labels"])
def test_rules_run_on_all_cores(spark, name):
    assert plans.QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_group_in_a_lambda_is_matched_once(spark):
    """F4 to F8, F11: ``nullif`` in a lambda wrote, and ran, its pattern twice."""
    df = spark.createDataFrame([(["a1", "b", None],)], "t array<string>")
    found = df.select(F.transform("t", lambda t: text.group(t, r"(\d)")).alias("g"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
    assert found.first()["g"] == ["1", None, None]


def test_clean_texts_are_those_that_cleaning_leaves_alone(spark):
    texts = ["", " ", "a b", " a", "a ", "a  b", "a ,b", "a -b", "a - b", "a (b)", "( b", "[ b", "a​b", "a\xa0b", "a\nb",
             "a\x1fb", "a b", "a　b", "a\x85b", "a !", "a )", "x y", "‎", "a\n", "1 -5", "a-b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", text.clean(F.col("t")).alias("a"), text._cleaned(F.coalesce("t", F.lit(""))).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_large_tables_are_looked_up_whole(spark):
    table = {f"k{i}": i for i in range(300)} | {"ä": 300}
    df = spark.createDataFrame([(k,) for k in [*table, "none", "", None]], "k string")
    rows = df.select("k", values.lookup(table, F.col("k")).alias("v")).collect()
    assert [r["v"] for r in rows] == [table.get(r["k"]) for r in rows]


def test_stored_steps_leave_no_shuffle_behind(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        return {n for n in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()))
                if n.startswith("shuffle_")}

    before, own = shuffled(), spark.conf.get(common.CLEANUP_CONF)
    df = common.stored(spark.range(1000).groupBy(F.col("id") % 7).count(), "step")
    end = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not shuffled() - before and df.count() == 7 and spark.conf.get(common.CLEANUP_CONF) == own
