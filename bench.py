"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated choice of registered queries (``all`` for every one).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from stayline.session import local_session, scratch_tables

HEADLINE = (
    "cohort_members",
    "account_later",
    "first_last_status_initial",
    "first_last_status_later",
    "sessions_initial",
    "sessions_later",
    "slide_type_counts",
    "event_profile",
    "churn_retention",
    "feature_nonusers_by_status",
    "participated_before_presenting",
    "teacher_totals",
    "bucket_shares_5",
    "slide_diversity",
    "feature_mart",
    "model_table",
    "cutoff_sweep",
)


def run(spark: SparkSession, name: str, root: str) -> None:
    """Run a query to a null sink; the tables it wrote on the way go afterwards."""
    with scratch_tables(spark):
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(QUERIES) if chosen == "all" else chosen.split(",")
    spark = local_session("bench", cores, memory="16g")
    # the first queries pay for compiling the JVM's code; these two are not counted
    for name in ("churn_retention", "feature_mart"):
        run(spark, name, root)
    seconds = {}
    for name in names:
        started = time.perf_counter()
        run(spark, name, root)
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
