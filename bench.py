"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postloom.catalog import QUERIES  # noqa: E402
from postloom.session import get_session  # noqa: E402

HEADLINE = [
    "clean_pages",
    "canonical_urls",
    "fingerprints",
    "challenge_counts",
    "text_dedup",
    "requisition_dedup",
    "identity_dedup",
    "profile_match",
    "profile_counts",
    "company_match",
    "unseen_listings",
    "dry_pages",
    "stalled_pages",
    "source_cap",
    "career_links",
    "greenhouse_postings",
    "lever_postings",
    "workday_postings",
    "triage",
    "page_fallback",
    "page_cards",
    "resolved_postings",
    "tiered_merge",
    "published_store",
    "components",
    "progress_update",
    "frontier",
    "store_two_versions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        # The first run loads and compiles; the second is the one that counts.
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
