"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3). Every query is
planned and run anew each time, its result discarded; "queries" holds the best run, "first_run" the first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from outletscope.plans.queries import QUERIES  # noqa: E402
from outletscope.sources.session import local_session  # noqa: E402

HEADLINE = [
    "monthly_sales",
    "focus_links",
    "top_switch",
    "top_switch_customers",
    "top_originator",
    "top_originator_customers",
    "switch_total",
    "originator_total",
    "margin_total",
    "margin_total_customers",
    "launch_scorecard",
    "launch_scorecard_customers",
    "molecule_month",
    "molecule_range",
    "molecule_range_customers",
    "share_gap",
    "eligible_outlets",
    "display_molecules",
    "total_row",
    "business_days",
    "density_bands",
    "report_totals",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, "bench", **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})

    runs: dict[str, list[float]] = {}
    for name in HEADLINE:
        runs[name] = []
        for _ in range(repeat):
            started = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            runs[name].append(round(time.perf_counter() - started, 3))
    spark.stop()

    best = {name: min(times) for name, times in runs.items()}
    scale = re.search(r"sf([\d.]+)", directory)
    print(
        json.dumps(
            {
                "metric": "sum of best run per headline query",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": {name: times[0] for name, times in runs.items()},
                "sf": float(scale.group(1)) if scale else directory,
            }
        )
    )


if __name__ == "__main__":
    main()
