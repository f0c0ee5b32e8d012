"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fingerprint", "text_structure_unicode", "parse_regex", "parse_jsonpath", "parse_cef_extension", "parse_kv_quoted",
    "parse_dispatch", "discovery_timeline", "events_per_action", "full_pipeline", "core_event", "provenance",
    "job_progress", "rule_lock", "latency_summary", "redact_documents",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from loglattice.plans import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("loglattice-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    from loglattice.plans import fixtures as fx

    events = sum(fx.table(spark, sf, kind.table).count() for name, kind in fx.KINDS.items() if name != "mix")
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
        "pipeline_events": events, "pipeline_events_per_sec": round(events / times["full_pipeline"], 1), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
