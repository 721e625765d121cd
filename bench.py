"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from signaloom.plans import registry
from signaloom.session import build_session

HEADLINES = (
    "protocol_statistics", "summary_kpis", "top_talkers", "hourly_buckets", "flow_table", "session_summary",
    "request_latency", "diameter_session_latency", "handover_interruptions", "keepalive_runs", "stream_accounting",
    "last_signup_before_purchase", "address_owner_as_of", "legs_claimed_within_tolerance", "registry_best_match",
    "key_merge_sessions", "session_rollup", "subscribers", "procedures", "sip_sessions", "call_flows", "stream_quality",
    "diagram_rows", "gtp_sessions",
)
#: Short reports, run again after all others: their first run is mostly start-up.
WARM = ("protocol_statistics", "summary_kpis", "top_talkers", "hourly_buckets")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}

    def timed(name: str) -> float:
        begun = time.perf_counter()
        registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begun, 3)

    for name in HEADLINES:
        seconds[name] = timed(name)
    warm = {name: median(timed(name) for _ in range(3)) for name in WARM}
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "warm_median_of_3": warm,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
