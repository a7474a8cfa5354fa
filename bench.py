"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then three times; the median wall time is reported. Results are
written to the ``noop`` sink, so every row is computed and nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuscope.plans import catalog as C  # noqa: E402
from corpuscope.session import build_session  # noqa: E402

HEADLINE = ["taint_flow", "secret_patterns", "secret_entropy", "duplicate_blocks", "repair_dry_run"]
EXTRA = ["all_issues", "severity_breakdown", "fuse_merge", "sarif_roundtrip", "issue_report_lines", "links_encoded"]
INPUT_TABLE = {"repair_dry_run": "pages", "links_encoded": "pages"}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="corpuscope-bench")
    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages")}
    times, rates = {}, {}
    for name in HEADLINE + EXTRA:
        q = C.QUERIES[name]
        run(q(spark, sf_dir))  # warm-up (JIT, Python workers, file cache)
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(q(spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        rows = counts[INPUT_TABLE.get(name, "documents")]
        rates[name] = round(rows / times[name], 1) if times[name] > 0 else None
    total = round(sum(times[n] for n in HEADLINE), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "rows_per_sec": rates,
        "input_rows": counts,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
