"""python tests/run_compare.py [sf_dir] [name prefix ...] - prints one line per query."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, diff  # noqa: E402

from featureflow.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
want = sys.argv[2:]
spark = build_session("compare", cores="8")
con = connect(sf)
sql = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if want and not any(name.startswith(w) for w in want):
        continue
    t = time.time()
    try:
        if name in sql:
            d = diff(spark, con, sf, fn, sql[name])
        else:
            d = None if fn(spark, sf).count() else "no rows"
            name += " (rows only)"
    except Exception as e:
        d = f"{type(e).__name__}: {str(e)[:700]}"
        if "-v" in want:
            traceback.print_exc()
    bad += d is not None
    print(f"{'ok ' if d is None else 'BAD'} {time.time() - t:6.2f}s {name} {d or ''}", flush=True)
print("bad:", bad)
