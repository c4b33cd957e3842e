"""Headline queries, timed one by one; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "canonical_urls title_identities published_parse freshness_reasons keyword_evidence keyword_scores "
    "funnel_grouping_sets round_robin first_n_qualifying dedup_same_hash history_anti_join contained_titles "
    "dedup_keep_first topic_digest latest_report history_search merge_apply bundle_violations feed_health "
    "page_bodies score_cache_lookup suggest_keywords stream_freshness_side_output"
).split()


def main() -> None:
    from newsops.queries import QUERIES
    from newsops.session import local_session

    spark = local_session(CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()          # start the executors before timing
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
