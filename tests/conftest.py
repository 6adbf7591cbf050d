from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfproof.schema import LISTING  # noqa: E402
from shelfproof.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def listings(spark, tmp_path):
    """Listings from plain dicts, read the way a feed is."""
    def make(records):
        path = tmp_path / f"listings-{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(json.dumps(dict(r, ord_at=i)) for i, r in enumerate(records)), encoding="utf-8")
        from pyspark.sql import types as T
        schema = T.StructType([*LISTING.fields, T.StructField("ord_at", T.LongType())])
        return spark.read.schema(schema).json(str(path)).withColumnRenamed("ord_at", "ord")

    return make
