"""Command-line check: python -m tests.check [sf] [name-prefix ...]"""

import sys
import time
import traceback

from liftwise.session import local_session
from tests.oracle import TIMES, compare, connect
from workload import ORACLES, QUERIES

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(d)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                diff = compare(spark, con, fn, ORACLES[name], d)
                times = "spark %.2fs sql %.2fs rows %d " % TIMES[-1]
                status = times + "ok" if diff is None else times + "DIFF " + diff
            else:
                status = f"rows {len(fn(spark, d).collect())}"
                diff = None
        except Exception as e:
            diff = str(e)
            status = "ERROR " + "".join(traceback.format_exception_only(e))[:1500]
        bad += diff is not None
        print(f"{name:30s} {time.time() - t:6.2f}s {status[:600]}", flush=True)
    print("failures:", bad)
    spark.stop()
