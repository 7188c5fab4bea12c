"""Time the headline analyses at one scale factor; print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (timed runs per query, default 2; the best is reported).
Each query runs to completion into Spark's no-op sink (nothing collected),
after one untimed warm-up pass over all queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "cohort_retention", "rfm_segmentation", "conversion_funnel", "conversion_funnel_by_country",
    "dau_wau_mau", "revenue_breakdown", "customer_ranking", "executive_summary",
    "funnel_what_if", "scenario_comparison",
)


def main() -> None:
    from basketry.plans.catalog import QUERIES
    from basketry.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    scratch = tempfile.mkdtemp(prefix="basketry-bench-")
    extra = {"spark.checkpoint.dir": os.path.join(scratch, "ckpt")}
    for kv in filter(None, os.environ.get("BENCH_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        extra[k] = v
    spark = local_session(cpus=cpus, partitions=cpus, app="basketry-bench", extra=extra)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in HEADLINE:
        run(name)
    times = {name: round(min(run(name) for _ in range(repeat)), 3) for name in HEADLINE}

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
