"""Write PLANS.md: executed-plan shape of the headline queries.

``python tools/plan_report.py [sf_dir]`` runs each query once.
"""

from __future__ import annotations

import os
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from basketry.plans.catalog import QUERIES  # noqa: E402
from basketry.plans.inspect import plan_counts, pushed_filters, single_partition_rows  # noqa: E402
from basketry.session import local_session  # noqa: E402
from bench import HEADLINE  # noqa: E402


def main(sf_dir: str) -> None:
    spark = local_session(partitions=8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="basketry-plans-")})
    lines = [
        "# Executed plans of the headline queries",
        "",
        f"Generated by `tools/plan_report.py` on `{sf_dir}` (local[8], 8 shuffle partitions, AQE on).",
        "Counts come from the final adaptive plan; what RFM and ranking store on the way (their input and",
        "the sorted ranges) is scanned by it and was computed before. *gathered* lists the runtime row",
        "counts of every shuffle into a single partition: a row per range, and the partial results of",
        "global aggregates.",
        "",
        "| query | scans | shuffles | reused | broadcasts | python | gathered rows | pushed status filter |",
        "|---|---|---|---|---|---|---|---|",
    ]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        c = plan_counts(df)
        pushed = any("EqualTo(o_orderstatus,F)" in f for f in pushed_filters(df))
        gathered = single_partition_rows(df)
        lines.append(f"| {name} | {c['scans']} | {c['exchanges']} | {c['reused']} | {c['broadcasts']} "
                     f"| {c['python_udfs']} | {gathered or '-'} | {'yes' if pushed else 'no'} |")
    lines += ["", "RFM and ranking push their status filter in the job that stores their input. `executive_summary`",
              "reads every status, so it has no status filter by design.", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
