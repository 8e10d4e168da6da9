"""Command line check: python -m tests.check [sf folder] [name prefix ...]"""

import sys
import time
import traceback

import __spark_entry__ as entry
from tapeloom.session import local_session
from tests.oracle import compare, connect


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                msg = compare(spark, con, name, fn, oracle[name], folder)
            else:
                msg = f"NO SQL rows={fn(spark, folder).count()}"
        except Exception as e:
            msg = "ERROR " + str(e)[:600]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += bool(msg) and not msg.startswith("NO SQL")
        print(f"{name:32s} {time.time() - t0:6.1f}s {msg or 'ok'}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
