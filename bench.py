"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lintmill.catalog.queries import QUERIES  # noqa: E402
from lintmill.session import local_session  # noqa: E402

HEADLINE = [
    "riskiest_files", "file_metrics", "lint_parse", "sev_counts", "top3_by_category", "lineage_edges",
    "match_contains", "issue_line", "cell_locate", "rw_general", "section_parse", "modifications",
    "validations", "first_match_line", "apply_lines", "apply_fold", "file_report", "portfolio_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="lintmill-bench-")
    spark = local_session(cpus, "bench", spark__checkpoint__dir=shared)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
