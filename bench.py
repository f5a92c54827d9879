"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder with the tables, BENCH_CPUS: cores of the local session.
"""

import json
import os
import time

from tallyfold.plans.catalog import QUERIES
from tallyfold.session import local_session

HEADLINE = (
    "reconcile_totals", "document_gate", "latest_stage", "invoice_list", "find_identifiers",
    "find_money", "header_wide", "line_items", "doc_type", "parse_answers", "merge_candidates",
    "dedupe_exact", "words_to_lines", "page_stats", "search_fields", "export_wide",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
