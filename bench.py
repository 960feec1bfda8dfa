"""Headline queries at one scale factor; prints one JSON line.

Each query runs to a sink that keeps nothing, so all rows and columns are computed. A short query
first starts the JVM, so that the first headline query does not pay for that. Other queries can be
named on the command line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bazaarlens.plans import QUERIES
from bazaarlens.session import local_session

HEADLINE = (
    "opportunity_scores",
    "resolved_listings",
    "listing_upsert",
    "identifier_consensus",
    "decide_listings",
    "clean_decision",
    "detect_language",
    "resolve_products",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["review_summary"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
