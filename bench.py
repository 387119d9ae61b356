"""Time the headline queries; prints one JSON line.

``value`` is the total of the headline queries, the same ones in every round.  ``notes`` are queries that read a note for every order; they are timed too but not in the total.
``BENCH_RUNS`` (1) runs give medians; ``BENCH_ALL=1`` times every registered query.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from loomtide.plans.registry import QUERIES

HEADLINE = ["upcoming_headers", "today_list", "upcoming_list", "search_list", "task_totals", "completion_stats", "completion_histogram", "reminder_sweep", "reminder_times", "civil_dates", "folded_titles", "turn_similarity", "usage_days", "latency_percentiles"]
NOTES = ["extraction_round_trip", "corrected_notes"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    more = [q for q in QUERIES if q not in HEADLINE] if os.environ.get("BENCH_ALL") else NOTES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["task_totals"](spark, sf_dir).collect()  # starts the JVM's code paths

    def timed(name: str) -> float:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return round(statistics.median(took), 3)

    took = {name: timed(name) for name in HEADLINE}
    notes = {name: timed(name) for name in more}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "notes": notes, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
