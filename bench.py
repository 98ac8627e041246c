"""Headline benchmark: the seven reports, each alone and the median reports on a shared base.

Prints one JSON line.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores,
``BENCH_RUNS`` the timed runs after one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.queries import survey  # noqa: E402
from hearthstat.plans import indicators as reports  # noqa: E402
from hearthstat.workspace import Workspace  # noqa: E402


def evaluate(report: reports.Report) -> None:
    report.table.collect()
    if report.national is not None:
        report.national.collect()


def on_base(*functions):
    def run(spark, sf_dir):
        with Workspace(spark) as space:
            base = reports.transport_base(survey(spark, sf_dir), space)
            for function in functions:
                evaluate(function(base))

    return run


def perception(spark, sf_dir):
    evaluate(reports.perception(survey(spark, sf_dir)))


def spend(codes):
    def run(spark, sf_dir):
        with Workspace(spark) as space:
            evaluate(reports.spend_by_decile(survey(spark, sf_dir), space, codes))

    return run


MEDIAN_REPORTS = (
    reports.families_below_decile_median,
    reports.gap_to_decile_median,
    reports.half_median_detail,
    reports.half_median_totals,
)
QUERIES = {
    "i1_perception": perception,
    "i2_fuel_spend": spend("fuel"),
    "i3_public_transport_spend": spend("public"),
    "i4_families_below_decile_median": on_base(MEDIAN_REPORTS[0]),
    "i5_gap_to_decile_median": on_base(MEDIAN_REPORTS[1]),
    "i6_half_median_detail": on_base(MEDIAN_REPORTS[2]),
    "i7_half_median_totals": on_base(MEDIAN_REPORTS[3]),
    "i4_to_i7_shared_base": on_base(*MEDIAN_REPORTS),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus=cpus, partitions=cpus)
    seconds = {}
    for name, run in QUERIES.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(spark, sf_dir)
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "seven_reports_total",
                "value": round(sum(s for n, s in seconds.items() if "shared" not in n), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
