"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from shopledger.checks import QUERIES

HEADLINE = [
    "u02_replace_overlap", "w01_raw_duplicates", "d04_finalize_orders", "j02_row_audit", "d10_daily_fact", "d12_month_totals",
    "d16_item_month", "j06_item_day_grid", "d18_price_volume", "d19_item_profile", "l20_rule_anomalies", "d20_baskets",
    "l02_itemsets", "w23_recommend", "d21_rfm_features", "w16_followups", "l16_backtest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shopledger-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    started = time.time()
    QUERIES["d16_item_month"](spark, folder).count()  # shared derived tables are written here
    QUERIES["d05_customer_metrics"](spark, folder).count()
    timings["prepare_shared_tables"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
