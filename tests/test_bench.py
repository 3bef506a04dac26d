"""The bench prints one JSON line, whatever becomes of what it is compared with."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
CODE = """
import bench, __spark_entry__ as e
q = e.queries()
e.queries = lambda: {k: q[k] for k in ("validate_unique", "insert_validated")}
if %r:
    bench.beside = lambda *a: 1 / 0
bench.main()
"""


@pytest.mark.parametrize("broken", [False, True])
def test_bench(tmp_path, broken):
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2"}
    run = subprocess.run([sys.executable, "-c", CODE % broken], cwd=tmp_path, env=env | {"PYTHONPATH": str(HERE)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    (line,) = run.stdout.splitlines()
    out = json.loads(line)
    assert set(out) == {"metric", "value", "unit", "queries", "sf", "duckdb"} and out["unit"] == "sec" and out["sf"] == "0.001"
    assert set(out["queries"]) == {"validate_unique", "insert_validated"} and all(t > 0 for t in out["queries"].values())
    assert (set(out["duckdb"]) == {"error"}) == broken
