"""python tests/check.py [sf] [name-prefix ...]: compare queries with their twins."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tests import harness  # noqa: E402
from vacantia.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = harness.duck(sf_dir)
    bad = []
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                count, problem = harness.compare(df, con, oracles[name])
            else:
                count, problem = df.count(), None
        except Exception as exc:
            count, problem = -1, f"{type(exc).__name__}: {str(exc)[:600]}"
            if "-v" in prefixes:
                traceback.print_exc()
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:42s} {count:7d} rows {time.time() - start:6.2f}s {'' if name in oracles else '(no twin)'} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
