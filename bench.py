"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.queries import QUERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "sector_benchmark", "portfolio_kpis", "overrun_histogram", "state_watchlist", "search_projects", "top_risk_projects",
    "clean_number_cell", "fill_down_header", "derive_snapshot_labels", "dedupe_keep_last", "attach_by_key_first", "upsert",
    "nearest_centroid", "propagate_geo", "fuzzy_match", "pace_features", "median_impute", "oof_target_rate", "price_escalation",
    "auc", "recall_at_top", "exposure_top_share", "person_period", "life_table", "c_index", "validate_rules",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sector_benchmark"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder}))


if __name__ == "__main__":
    main()
