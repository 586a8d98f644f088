"""Times the headline jobs and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
cores. Stage tables are written as in production, and their time is part of the job
that builds them. The small sibling folder warms the JVM up first.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from quarterdeck.queries import changes, forecasts
from quarterdeck.queries.registry import QUERIES
from quarterdeck.queries.tables import Tables
from quarterdeck.session import Workspace, build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 8)

#: name -> what is timed; the stages it reads were built by the jobs before it
JOBS = {
    "bronze_parse": lambda t: (t.all_filings(), t.lines()),
    "silver_build": lambda t: t.silver(),
    "silver_last_build": lambda t: t.silver_last(),
    "effective_filings": lambda t: t.effective_filings(),
    "quality_metrics": "quality_metrics",
    "reconcile": "reconcile",
    "manager_cohort": "manager_cohort",
    "peer_stats_build": lambda t: t.peers(),
    "gold_build": lambda t: t.gold(),
    "candidate_coverage": "candidate_coverage",
    "folds_v2": "folds_v2",
    "leakage_audit": "leakage_audit",
    "forecast_materialisation": "forecast_materialisation",
    "forecast_page": "forecast_page",
    "forecast_page_again": "forecast_page",
    "forecast_metrics": forecasts.metrics,
    "position_deltas": changes.deltas,
    "materiality_scores": changes.assessed,
    "client_portfolios": "client_portfolios",
}


def run(spark, folder: str) -> dict[str, float]:
    Workspace(spark, folder).forget()
    tables, spent = Tables(spark, folder), {}
    for name, job in JOBS.items():
        started = time.perf_counter()
        if callable(job):
            job(tables)  # writes its stage
        else:
            QUERIES[job](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    return spent


def main() -> None:
    spark = build_session(f"local[{CPUS}]", "bench", shuffle_partitions=CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(FOLDER).parent / "sf0.001"
    if small.is_dir() and str(small) != FOLDER:
        run(spark, str(small))
    spent = run(spark, FOLDER)
    print(json.dumps({
        "metric": "holdings_pipeline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": Path(FOLDER).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
