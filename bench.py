"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. The stored tables that the
queries read (filings by quarter, prices, submissions, state, provenance, signals) are made from them once, untimed,
as Parquet; what is timed is the operators on stored tables, planning included. Every query runs ``BENCH_RUNS``
(default 3) times to completion, its whole result computed and thrown away, and the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import catalog, views
from tidemark.session import fresh_dir, local_session

HEADLINE = (
    "event_study_by_code", "event_study_by_symbol", "event_preparation", "backtest_summary", "signal_outcomes",
    "performance_summary", "price_coverage", "transaction_filter", "historical_read", "integrity_audit",
    "period_verification", "reconciliation_summary", "order_risk",
)
#: Views over the given tables that stand for stored tables, and what they are partitioned by.
STORED = {"lines": None, "submissions": None, "filings": "filing_period", "prices": None, "state": None,
          "archive_inventory": None, "provenance": None, "signals": None}


def store(spark, folder: str) -> None:
    """Write each view and let the queries read the files in its place."""
    made = {name: getattr(views, name)(spark, folder) for name in STORED}
    for name, by in STORED.items():
        path = fresh_dir(spark, f"bench-{name}")
        writer = made[name].write
        (writer.partitionBy(by) if by else writer).parquet(path)
        schema = made[name].schema
        setattr(views, name, lambda spark, d, path=path, schema=schema: spark.read.schema(schema).parquet(path))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, memory="12g", partitions=int(cores) if cores.isdigit() else 8)
    store(spark, folder)
    catalog.QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs):
            start = time.time()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            each.append(time.time() - start)
        taken[name] = round(statistics.median(each), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cores, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
