"""Task functions must work where this package is not installed."""

import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from liftwise.llm import decontaminate, hard_negatives, near_text, secret_scan
from liftwise.llm.automaton import compile_patterns

LOAD = "import sys, pyarrow as pa; from pyspark import cloudpickle; fn = cloudpickle.load(open(sys.argv[1], 'rb')); assert 'liftwise' not in sys.modules; "


def run_elsewhere(tmp_path, fn, call):
    path = tmp_path / "fn"
    path.write_bytes(cloudpickle.dumps(fn))
    done = subprocess.run([sys.executable, "-I", "-c", LOAD + call, str(path)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def test_tasks_travel(tmp_path):
    rules = secret_scan.RULES
    scan = secret_scan._scanned(compile_patterns([r.pattern for r in rules]), rules, ["doc_id"], "spans")
    batch = "pa.record_batch({'doc_id': pa.array([1]), '_text': pa.array(['a token=abcdefghijklm'])})"
    assert "assign" in run_elsewhere(tmp_path, scan, f"print([r.to_pylist() for r in fn(iter([{batch}]))])")
    batch = "pa.record_batch({'rid': pa.array([1]), 'values': pa.array([[1, -2, 3]])})"
    assert run_elsewhere(tmp_path, hard_negatives._packed, f"print(sum(b.num_rows for b in fn(iter([{batch}]))))") == "1"
    leaks = decontaminate._document_rows([(True, 2)], np.packbits(np.ones(1 << decontaminate.FILTER_BITS, bool)), decontaminate.code_points())
    batch = "pa.record_batch({'h1': pa.array([1]), 'h2': pa.array([2]), 'text': pa.array(['two words and 3 more'])})"
    assert int(run_elsewhere(tmp_path, leaks, f"print(sum(b.num_rows for b in fn(iter([{batch}]))))")) > 0
    batch = "pa.record_batch({'left': pa.array([1]), 'right': pa.array([2]), 'one': pa.array(['a b']), 'two': pa.array(['a b'])})"
    assert run_elsewhere(tmp_path, near_text._checked(5, 80), f"print(sum(b.num_rows for b in fn(iter([{batch}]))))") == "1"
