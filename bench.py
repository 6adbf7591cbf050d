"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8).  Each query runs
once to warm the JVM and once measured, from building its plan to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfproof import plans  # noqa: E402
from shelfproof.session import build  # noqa: E402

HEADLINE = (
    "freshest_merge", "merge_provenance", "quantity_reconcile", "price_per_base_band", "variation_offers",
    "rank_offers", "excluded_offers", "status_summary", "compare_pairs", "nutrition_long", "nutrition_values",
    "histogram_rating", "review_signals", "claim_search", "claim_affirmative", "clean_text", "locale_number",
    "review_cards", "page_titles", "page_bullets", "page_redact", "page_extract", "search_sightings",
    "sighting_stats", "sighting_rank", "lineage_join", "snapshot_diff", "pasta_cards", "paste_cards", "rice_cards",
    "stream_freshest", "stream_windows",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
        times[name] = round(took, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
