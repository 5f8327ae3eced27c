"""Headline queries, one JSON line: `BENCH_SF_DIR` (default sf0.1) on `local[BENCH_CPUS]`."""

from __future__ import annotations

import json
import os
import sys
import time

from fieldledger import adapters, catalog
from fieldledger.catalog.filters import stores
from fieldledger.catalog.sources import posting_rows, published
from fieldledger.plans.stores import newest_found
from fieldledger.session import build

HEADLINE = [
    "q01_job_search",
    "q02_companies_hiring",
    "q03_nightly",
    "q06_hospital_search",
    "q07_store_search",
    "q10_migration_delta",
    "q13_drop_alerts",
    "a15_catalog_facts",
    "a17_ledger_summary",
    "j06_attach_text",
    "s02_read_index",
    "s04_write_shards",
    "t01_html_to_text",
    "t20_extract_pay",
    "t25_role",
    "w04_source_drops",
    "w05_cap_per_group",
    "w14_recent_count",
]

#: What the searches among them read.
INDEXES = [("postings", posting_rows), ("postings whole", adapters.postings), ("stores", stores, newest_found, 200, "first_seen")]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    took = {}
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for n in names:  # classes are compiled before the clock runs
        catalog.QUERIES[n](spark, small).write.format("noop").mode("overwrite").save()
    for name, make, *how in INDEXES:  # searches read an index that is there already; s04 times the writing
        published(spark, sf, name, make, *[h() if callable(h) else h for h in how])
    for n in names:
        t0 = time.time()
        catalog.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - t0, 2)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
