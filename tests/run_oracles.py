"""Compare queries with their SQL twins: python tests/run_oracles.py SF [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from daywatch.session import local_session  # noqa: E402
from tests.compare import difference, duck  # noqa: E402


def main(sf, names):
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sqls = duck(sf_dir), entry.oracle_sql()
    queries = entry.queries()
    extra = set(sqls) - set(queries)
    if extra:
        print("SQL without query:", extra)
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                verdict = difference(df, con, sqls[name])
            else:
                verdict = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name}"
              f"{'' if verdict is None else ' ' + verdict}", flush=True)
        if verdict:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
