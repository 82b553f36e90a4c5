"""Compare every query with its SQL: ``python check.py [sf_dir] [name ...]``."""

import sys
import time

from corpuscope.plans import all_entries
from corpuscope.session import clear_scratch, local_session
from tests.compare import connect, differences


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, entry in all_entries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = entry.run(spark, sf_dir)
            if entry.sql is None:
                problems, note = [], f"rows only ({df.count()})"
            else:
                problems, note = differences(df, con, entry.sql), f"{df.columns}"[:60]
        except Exception as e:  # report and go on with the next query
            problems, note = [f"{type(e).__name__}: {str(e)[:900]}"], ""
        clear_scratch(spark)
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
