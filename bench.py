"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is planned and executed in full into Spark's no-op sink, so nothing is pruned
and nothing is collected. The session is warmed once before the clock starts. Smaller
scales beside the folder are timed as well; `growth` is the power of the input by which a
query's time grows from the smallest to the largest of them.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from featmart.plans import catalog
from featmart.session import build_session

HEADLINE = [
    "status_by_month", "risk_client_month", "risk_by_loan", "risk_by_client", "discounted_log_risk",
    "tracking_period_loan", "tracking_period_client", "variation_by_loan", "variation_by_client",
    "tracking_period_card", "client_month_agg", "client_number_agg", "rle_all_columns",
    "status_month_support", "pivot_months", "pivot_months_multi", "rle_divide", "last_version",
    "installment_versions", "by_installment", "expected_dpd_loan", "clean_installments",
    "key_overlap_matrix", "feature_mart", "auc_exact", "corr_spearman", "drift_ks",
]


def scale_of(folder: str) -> float:
    return float(os.path.basename(folder.rstrip("/")).removeprefix("sf"))


def smaller(folder: str) -> list[str]:
    """The scales a hundredth and a tenth as large, where they stand beside the folder."""
    parent, name = os.path.split(folder.rstrip("/"))
    if not name.removeprefix("sf").replace(".", "", 1).isdigit():
        return []
    near = [f"{parent}/sf{scale_of(folder) / part:g}" for part in (100, 10)]
    return [f for f in near if os.path.isdir(f)]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.PLANS["risk_by_loan"](spark, folder).write.format("noop").mode("overwrite").save()
    scales = {os.path.basename(f.rstrip("/")): f for f in smaller(folder)}
    by_scale = {scale: {name: timed(spark, name, path) for name in HEADLINE} for scale, path in scales.items()}
    seconds = {name: timed(spark, name, folder) for name in HEADLINE}
    growth = {}
    if by_scale:
        least, times = next(iter(by_scale.items()))
        span = math.log(scale_of(folder) / scale_of(scales[least]))
        growth = {name: round(math.log(seconds[name] / times[name]) / span, 2) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "smaller": by_scale, "growth": growth,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
