"""bench.py prints one JSON line with the agreed keys (run in its own process)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPS="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=900, cwd="/tmp")
    assert out.returncode == 0, out.stderr[-2000:]
    line = [l for l in out.stdout.splitlines() if l.startswith("{")][-1]
    rec = json.loads(line)
    assert rec["unit"] == "sec" and rec["value"] > 0 and rec["sf"] == 0.001
    assert {"taint_flow", "secret_patterns", "secret_entropy", "duplicate_blocks", "repair_dry_run"} <= set(rec["queries"])
