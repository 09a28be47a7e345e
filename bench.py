"""Time the headline queries and print one JSON line.

`BENCH_SF_DIR` names the data, `BENCH_CPUS` the number of local cores. All queries
run once unmeasured, then each `RUNS` times; the best time counts. Results are read
to the last row but not collected.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from threadlens.checks.queries import QUERIES

HEADLINE = [
    "normalize_ascii",
    "normalize_text",
    "extract_links",
    "ingest_posts",
    "ingest_posts_all",
    "top_posts_single",
    "top_posts_large",
    "ingest_comments",
    "flatten_tree",
    "thread_text",
    "thread_text_orders",
    "analysis_prompt",
    "answer_prompt",
    "answer_decision",
    "condense",
    "condense_callable",
    "condense_incremental",
    "resume_pending",
    "processing_totals",
    "csv_roundtrip",
    "ingest_json",
    "ingest_stream",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        timed(name)
    seconds = {
        name: round(min(timed(name) for _ in range(RUNS)), 3) for name in HEADLINE
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of the best times of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
