"""Run every registered query at sf0.01 (or $CHECK_SF_DIR) in Spark and its
oracle SQL in DuckDB; print one line per query.  Usage:
  python check_queries.py [name-substring ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketlens.plans.registry import load_all  # noqa: E402
from basketlens.session import build_session  # noqa: E402
from basketlens.sources.adapter import canon  # noqa: E402
from tests.harness import compare, duck  # noqa: E402


def main(argv):
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session()
    con = duck(sf)
    c = canon(spark, sf)
    bad = 0
    for name, q in load_all().items():
        if argv and not any(a in name for a in argv):
            continue
        t = time.time()
        try:
            df = q.build(c)
            if q.sql is None:
                n = df.count()
                ok, msg = True, f"{n} rows (no oracle)"
            else:
                ok, msg = compare(df, q.sql, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:40s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
