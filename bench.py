"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import re
import sys
import time

HEADLINE = (
    "src10_scan",
    "ag1_region_summary",
    "ag2_type_summary",
    "ag4_window_stats",
    "ag10_price_snapshot",
    "ag17_lease_snapshot",
    "ag22_metric",
    "ag29_cluster_gain",
    "ag39_annual_panel",
    "jn1_match_address",
    "jn5_nearest",
    "wn1_rank_candidates",
    "wn6_latest_per_key",
    "ui6_growth_ranking",
    "st2_ledger",
    "prj5_normalize_sale",
    "ag9_monthly_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pricetide.plans import registry
    from pricetide.session import build_session

    registry.load_all()
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session("bench", cores=cpus, **{"spark.sql.shuffle.partitions": cpus})
        # One untimed query warms the JVM, as any long-running session would be.
        registry.QUERIES["ui11_summary_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds = {}
        for name in names:
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        spark.stop()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
