"""Command-line check: python tests/run_twins.py [-d dir] [-p] [name prefixes...]"""

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from twins import compare  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from codequarry.session import build_session  # noqa: E402

parser = argparse.ArgumentParser()
parser.add_argument("-d", default="/root/testdata/sf0.001")
parser.add_argument("-p", action="store_true", help="print the plan")
parser.add_argument("names", nargs="*")
args = parser.parse_args()
spark = build_session("local[8]")
jobs, sqls = entry_module.queries(), entry_module.oracle_sql()
bad = 0
for name, job in jobs.items():
    if args.names and not any(name.startswith(n) for n in args.names):
        continue
    began = time.time()
    try:
        if args.p:
            job(spark, args.d).explain("formatted")
        if name in sqls:
            problems = compare(spark, job, sqls[name], args.d)
        else:
            problems = [] if job(spark, args.d).count() else ["no rows"]
    except Exception as exc:  # noqa: BLE001
        problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
    bad += bool(problems)
    print(("BAD " if problems else "ok  ") + f"{name} {time.time() - began:.1f}s" + ("" if name in sqls else " (rows only)"), flush=True)
    for problem in problems:
        print("     ", problem)
print("failures:", bad)
